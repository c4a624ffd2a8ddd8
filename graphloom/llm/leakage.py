"""Held-out items that turn up in a corpus, whole or in part, by a prefix-filtered set join.

A post repeats an item if it holds a run of consecutive item tokens (12 words, or 20 characters of zh and
ja text), or at least three quarters of the item's tokens in the item's order: anywhere in the post
(``slack=None``, as the queries have it), or within a window of ``slack`` times the item's size. Only
letters and digits count, case doesn't.

1. Tokens and shingles (4 words, 8 characters) of the items, each under a 64-bit key. A first pass over the corpus
   counts in how many posts each of them occurs: the order by rarity.
2. Prefixes. A run of 12 words holds nine shingles, so it can't miss the rarest of them: per window of an item only
   that one is a key. An ordered match of t of n tokens misses at most n - t of them, so it holds at least l of the
   n - t + l rarest ones: only these are keys, and a post needs l of them.
3. Join. A second pass over the corpus lets through the posts that hold such keys, with those keys, and joins them with
   the items' keys: once for each distinct text, however many posts it stands in. A post with fewer tokens than a
   match needs is out (length), as is one whose keys of the item are fewer than l.
4. Exact check of the pairs that are left, on the tokens themselves: runs by their shingles, ordered matches by a
   bit-parallel longest common subsequence over the places of the item's tokens, or over every window whose places
   lie near enough (position).

The corpus is read twice, however many items there are; items and posts meet by a shuffled join, and posts that hold no
key leave neither their task nor a trace. What is shipped with the tasks is a bit table of the keys (16 bits a key, at
most 32 MB; a fuller table lets more through and loses none).

Defined results: null or empty posts and items match nothing; an item shorter than a run can only
match by three quarters of its tokens; repeated rows give one row per (post, item); an item that stands in
several rows matches if one of them does. A zh or ja item is compared by characters, with posts that hold
Han or kana at all.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.shipping import ship
from graphloom.storage import counted, materialize

RUN_WORDS, RUN_CHARS, SHARE, SLACK = 12, 20, 0.75, 1.5
#: words or characters of one shingle
SHINGLE_WORDS, SHINGLE_CHARS = 4, 8
#: of the tokens that an ordered match needs, one in so many has to be in its prefix (and one more)
PREFIX_STEP = 8
#: bits of the shipped key table: per key, and at most
KEY_BITS, MOST_BITS = 16, 1 << 28
#: tokens whose keys one task remembers
REMEMBERED = 1 << 20

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,32});|(?<=\])\((?:https?://|/)[^\s()]*\)")
_WORD = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿豈-﫿]")
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KINDS = {False: (np.uint64(1), np.uint64(2), SHINGLE_WORDS), True: (np.uint64(3), np.uint64(4), SHINGLE_CHARS)}


def words(text: str) -> list[str]:
    """Words of letters and digits, without markup."""
    return _WORD.findall(_TAG.sub(" ", text).casefold())


def characters(text: str) -> list[str]:
    return list("".join(words(text)))


def by_characters(text: str, lang: str | None) -> bool:
    """The item is one of zh or ja text."""
    found = len(_DENSE.findall(text))
    return bool(found) and ((lang or "").lower()[:2] in ("zh", "ja") or found * 2 > len("".join(words(text))))


# ---------------------------------------------------------------- exact check


def holds_run(item: list[str], post: list[str], run: int) -> bool:
    """Some ``run`` consecutive tokens of the item stand together in the post."""
    own = {tuple(item[i : i + run]) for i in range(len(item) - run + 1)}
    known, streak = set(item), 0
    for i, t in enumerate(post if own else ()):
        streak = streak + 1 if t in known else 0
        if streak >= run and tuple(post[i - run + 1 : i + 1]) in own:
            return True
    return False


def in_order(item: list[str], post: list[str], slack: float | None) -> bool:
    """Three quarters of the item's tokens stand in the post (in one window of it) in the item's order."""
    n, need = len(item), needed(len(item))
    masks: dict[str, int] = defaultdict(int)
    for i, t in enumerate(item):
        masks[t] |= 1 << i
    at = [(i, masks[t]) for i, t in enumerate(post) if t in masks]  # places of the item's tokens
    full = (1 << n) - 1
    width = len(post) + 1 if slack is None else int(n * slack) + 1
    for k in range(len(at) - need + 1):
        if at[k + need - 1][0] - at[k][0] >= width:
            continue  # no window from here holds enough of them
        row = full
        for i, mask in at[k:]:  # bit-parallel longest common subsequence
            if i - at[k][0] >= width:
                break
            m = row & mask
            row = ((row + m) | (row - m)) & full
        if n - row.bit_count() >= need:
            return True
        if slack is None:
            return False  # the first window is the whole post
    return False


def needed(n: int) -> int:
    """Tokens of an ordered match of an item of n."""
    return -(-n * 3 // 4)


# ---------------------------------------------------------------- keys


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Hashes(dict):
    """Hashes of tokens; forgets all when it has grown to its bound."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


def token_keys(texts: list[list[str]], dense: bool, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each token, token keys, text of each shingle, shingle keys) of several texts' tokens.

    The i-th shingle of a text begins at its i-th token."""
    one, many, size = _KINDS[dense]
    lengths = [len(t) for t in texts]
    n = sum(lengths)
    if dense:
        codes = np.frombuffer("".join("".join(t) for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        raw = _mixed(codes * _PRIME + np.uint64(7))
    else:
        raw = np.fromiter((hashes[w] for t in texts for w in t), np.uint64, n)
    owner = np.repeat(np.arange(len(texts)), lengths)
    grams, inside = np.zeros(max(0, n - size + 1), np.uint64), np.zeros(0, bool)
    if len(grams):
        for i in range(size):
            grams = grams * _PRIME + raw[i : i + len(grams)]
        inside = owner[: len(grams)] == owner[size - 1 :]
    return owner, _mixed(raw * _PRIME + one), owner[: len(grams)][inside], _mixed(grams[inside] * _PRIME + many)


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys whose bit is set; the table's size is a power of two."""
    places = keys & np.uint64(len(table) * 64 - 1)
    return ((table[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)


def _key_table(keys: DataFrame, n: int) -> np.ndarray:
    """The bit table of a column ``key``, built by the tasks; the driver gets its words, a bounded number."""
    bits = 1 << 12
    while bits < min(MOST_BITS, n * KEY_BITS):
        bits *= 2
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    lit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    found = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(lit).alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    got = found.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _held(texts: list[str], table: np.ndarray, hashes: _Hashes, any_dense: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]:
    """(text, key, occurrences) of the keys in the table that each text holds, by text; words and characters of each."""
    tokens = [words(t) for t in texts]
    owner, keys, gram_owner, grams = token_keys(tokens, False, hashes)
    parts = [(owner, keys), (gram_owner, grams)]
    chars = [0] * len(texts)
    dense = [i for i, t in enumerate(texts) if any_dense and _DENSE.search(t)]
    if dense:
        joined = [["".join(tokens[i])] for i in dense]
        for i, j in zip(dense, joined):
            chars[i] = len(j[0])
        owner, keys, gram_owner, grams = token_keys([list(j[0]) for j in joined], True, hashes)
        back = np.array(dense)
        parts += [(back[owner], keys), (back[gram_owner], grams)]
    kept = [(o[m], k[m]) for o, k in parts if len(k) for m in [_passes(table, k)]]
    o, k = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(o):
        order = np.lexsort((k, o))
        o, k = o[order], k[order]
        first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1]))))
        return o[first], k[first], np.diff(np.append(first, len(o))), [len(t) for t in tokens], chars
    return o, k, np.zeros(0, np.int64), [len(t) for t in tokens], chars


def _counter(table, any_dense: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            _, keys, *_ = _held(batch.column("text").to_pylist(), table.value, hashes, any_dense)
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return scan


_KEYS = "array<struct<key:bigint,n:int>>"


def _holder(table, any_dense: bool):
    kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            o, k, n, n_words, n_chars = _held(batch.column("text").to_pylist(), table.value, hashes, any_dense)
            some, begin = np.unique(o, return_index=True)
            values = pa.StructArray.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(o)).astype(np.int32)), values).cast(kind)
            rows = batch.take(pa.array(some, pa.int64()))
            sizes = [pa.array([x[i] for i in some.tolist()], pa.int32()) for x in (n_words, n_chars)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text"), lists, *sizes], ["id", "text", "keys", "n_words", "n_chars"])

    return scan


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every token and shingle of every item: (row, item, dense, n, pos, gram, key)."""
    hashes = _Hashes()
    for batch in batches:
        for row, text, lang in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "lang"))):
            dense = by_characters(text, lang)
            tokens = characters(text) if dense else words(text)
            _, keys, _, grams = token_keys([tokens], dense, hashes)
            for gram, own in ((False, keys), (True, grams)):
                m = len(own)
                columns = [pa.array([row] * m, pa.int64()), pa.array([dense] * m, pa.bool_()), pa.array([len(tokens)] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([gram] * m, pa.bool_()), pa.array(own.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["row", "dense", "n", "pos", "gram", "key"])


def _tokens(text: str, dense: bool) -> list[str]:
    return characters(text) if dense else words(text)


def _checker(slack: float | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post_tokens, item_tokens = lru_cache(16)(_tokens), lru_cache(1024)(_tokens)
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("text", "item_text", "dense", "run", "ordered"))
            for text, body, dense, run, ordered in zip(*columns):
                item, post = item_tokens(body, dense), post_tokens(text, dense)
                keep.append(bool(run and holds_run(item, post, RUN_CHARS if dense else RUN_WORDS) or ordered and in_order(item, post, slack)))
            yield batch.select(["digest", "row"]).filter(pa.array(keep, pa.bool_()))

    return scan


def _prefixes(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, row, dense, gram, weight, least, need): the keys that a match with the item's row can't all miss."""
    ranked = tokens.join(counts, "key", "left").withColumn("rarity", F.coalesce("n_posts", F.lit(0)))
    t = F.ceil(F.col("n") * 3 / 4).cast("int")
    least = (F.lit(1) + F.floor(t / PREFIX_STEP)).cast("int")
    rarest = F.row_number().over(Window.partitionBy("row").orderBy("rarity", "key", "pos"))
    single = ranked.where(~F.col("gram")).withColumn("r", rarest).where(F.col("r") <= F.col("n") - t + least)
    single = single.groupBy("key", "row", "dense", "gram").agg(F.count(F.lit(1)).cast("int").alias("weight"), F.first(least).alias("least"), F.first(t).alias("need"))

    def runs(dense: bool) -> DataFrame:
        run, size = (RUN_CHARS, SHINGLE_CHARS) if dense else (RUN_WORDS, SHINGLE_WORDS)
        window = Window.partitionBy("row").orderBy("pos").rowsBetween(0, run - size)
        own = ranked.where(F.col("gram") & (F.col("dense") == dense)).withColumn("low", F.min(F.struct("rarity", "key")).over(window))
        own = own.where(F.col("pos") <= F.col("n") - run)
        return own.select(F.col("low.key").alias("key"), "row", "dense", "gram", F.lit(1).alias("weight"), F.lit(1).alias("least"), F.lit(run).alias("need")).distinct()

    return single.unionByName(runs(False)).unionByName(runs(True))


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", lang: str = "lang", slack: float | None = SLACK) -> DataFrame:
    """``(doc_id, item_id)`` of every post and each item it repeats."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    own = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(item_id).alias("item"), F.col(item_text).alias("text"), F.col(lang).alias("lang")
    )
    own = materialize(own, "items")
    tokens = materialize(own.select("row", "text", "lang").mapInArrow(_item_keys, "row bigint, dense boolean, n int, pos int, gram boolean, key bigint"), "item_keys", count="dense")
    any_dense = counted(tokens) > 0
    every = tokens.select("key").distinct()
    known = spark.sparkContext.broadcast(_key_table(every, every.count()))
    seen = rows.select("text").mapInArrow(_counter(known, any_dense), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n_posts"))
    keys = materialize(_prefixes(tokens, seen), "prefixes")
    wanted = spark.sparkContext.broadcast(_key_table(keys.select("key").distinct(), counted(keys)))
    held = rows.mapInArrow(_holder(wanted, any_dense), f"id {dict(rows.dtypes)['id']}, text string, keys {_KEYS}, n_words int, n_chars int")
    held = materialize(held.withColumn("digest", F.unhex(F.md5("text"))), "held")
    pairs = _pairs(held, keys)
    texts = held.select("digest", "text").join(pairs.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    dense = tokens.groupBy("row").agg(F.first("dense").alias("dense"))
    bodies = own.select("row", F.col("text").alias("item_text")).join(dense, "row")
    checked = pairs.join(texts, "digest").join(bodies, "row").select("digest", "row", "text", "item_text", "dense", "run", "ordered").mapInArrow(_checker(slack), "digest binary, row bigint")
    found = checked.join(own.select("row", "item"), "row").select("digest", "item").distinct()
    return held.select("id", "digest").distinct().join(found, "digest").select("id", "item").distinct().toDF(doc_id, item_id)


def _pairs(held: DataFrame, keys: DataFrame) -> DataFrame:
    """(digest, row, run, ordered): texts and item rows that share enough keys of one kind."""
    one = held.select("digest", "keys", "n_words", "n_chars").groupBy("digest").agg(F.first("keys").alias("keys"), F.first("n_words").alias("n_words"), F.first("n_chars").alias("n_chars"))
    each = one.select("digest", "n_words", "n_chars", F.explode("keys").alias("k")).select("digest", "n_words", "n_chars", "k.key", F.col("k.n").alias("times"))
    size: Column = F.when(F.col("dense"), F.col("n_chars")).otherwise(F.col("n_words"))
    shared = each.join(keys, "key").where(size >= F.col("need"))
    enough = shared.groupBy("digest", "row", "gram").agg(F.sum(F.least("weight", "times")).alias("s"), F.max("least").alias("least")).where("s >= least")
    both = enough.groupBy("digest", "row").agg(F.max("gram").alias("run"), F.max(~F.col("gram")).alias("ordered"))
    return materialize(both, "candidates")


def leak_report(found: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Per item the number of posts that repeat it; items that didn't leak count 0."""
    per = found.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_posts"))
    return items.select(item_id).distinct().join(per, item_id, "left").select(item_id, F.coalesce("n_posts", F.lit(0)).alias("n_posts"))
