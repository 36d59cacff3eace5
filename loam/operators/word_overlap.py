"""Texts that have most of their words in common: candidates from several global token orders, then exact checks.

Similarity of two texts is the number of words in common, counted with repeats, over the longer text's number of words.

Candidates. A global order ranks all tokens; a text's prefix under it is its first token. There are two kinds. Orders
of words put rare words first: word w has key -log(u_j(w)) / weight(w), u_j a hash of w under order j and the weight
falling with document frequency, so that the prefix of order j is drawn anew for each j, nearly always among a text's
rare words. Orders of three neighbouring words weigh all alike; they serve large families of near copies, whose shared
words are frequent. A filter takes several orders of a kind, ``WORD_ORDERS`` or ``RUN_ORDERS``, and lets a pair through
only where both texts have the same prefix under every one of them; a pair is a candidate if one filter lets it through.
With a (weighted) Jaccard similarity J of its tokens, a pair is missed by all k filters of r orders with probability
(1 - J**r)**k. Filters of runs take more orders, as runs that many texts share would fill their buckets; in a family so
large that its words are frequent, each text has many partners, and groups need only one of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.words import letters_by_field, words_of_values, words_text
from loam.operators.bloom import possible_repeats, semi_join
from loam.operators.components import components
from loam.session import materialize

WORD_FILTERS, WORD_ORDERS, RUN_FILTERS, RUN_ORDERS = 24, 3, 12, 5
FILTERS, KEYS = WORD_FILTERS + RUN_FILTERS, WORD_FILTERS * WORD_ORDERS
#: Words in more than this share of the texts, and ``LEAST`` more, weigh less. There are at most (mean distinct words a text) / COMMON such words.
COMMON, LEAST = 0.002, 20
#: Bucket size up to which all its pairs are candidates at once; larger buckets go by their smallest member first.
NEAR = 24
#: Entries that one task takes of a bucket; larger buckets are salted. They are told by one id in ``PROBE``.
PORTION, PROBE = 8192, 64
#: Words whose keys a worker keeps.
CACHE = 100_000


def common_words(texts: DataFrame, column: str) -> dict[str, float]:
    """Weight of each frequent word, counted over all texts. ``column`` holds ``words_text``."""
    words = texts.select(F.explode(F.array_distinct(F.split(F.col(column), " "))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    least = LEAST + COMMON * texts.count()
    return {r.w: (least / r.n) ** 2 for r in counts.where((F.col("n") > F.lit(least)) & (F.col("w") != "")).toLocalIterator()}


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Orders:
    """Keys of words under all orders, kept for words that come again."""

    def __init__(self, common: dict[str, float]):
        self.common, self.at = common, {}
        self.seeds = np.frombuffer(b"".join(blake2b(b"order %d" % j, digest_size=8).digest() for j in range(KEYS + RUN_FILTERS * RUN_ORDERS)), np.uint64)
        self.keys, self.hashes = np.empty((1024, KEYS), np.float32), np.empty(1024, np.uint64)

    def learn(self, words: list[str]) -> None:
        if len(self.at) + len(set(words)) > CACHE:  # begins anew; a single text may exceed the limit, and then has its own table
            self.at = {}
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if not new:
            return
        start = len(self.at)
        while start + len(new) > len(self.keys):
            self.keys, self.hashes = np.concatenate([self.keys, np.empty_like(self.keys)]), np.concatenate([self.hashes, np.empty_like(self.hashes)])
        h = np.frombuffer(b"".join(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in new), np.uint64)
        x = _mixed(h[:, None] ^ self.seeds[None, :KEYS])
        weight = np.array([self.common.get(w, 1.0) for w in new])
        u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        self.keys[start:start + len(new)] = -np.log(u) / weight[:, None]
        self.hashes[start:start + len(new)] = h
        self.at.update(zip(new, range(start, start + len(new))))

    def filters(self, words: list[str]) -> np.ndarray:
        """One hash a filter, of the tokens that come first under its orders. ``words`` is the whole text."""
        try:
            at = [self.at[w] for w in words]
        except KeyError:
            self.learn(words)
            at = [self.at[w] for w in words]
        at = np.array(at)
        distinct = np.unique(at)
        first = self.hashes[distinct[np.argmin(self.keys[distinct], axis=0)]].reshape(WORD_FILTERS, WORD_ORDERS)
        h = self.hashes[at]
        with np.errstate(over="ignore"):
            runs = h if len(h) < 3 else h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            ranks = runs[:, None] * (self.seeds[None, KEYS:] | np.uint64(1))
            run = runs[np.argmin(ranks ^ (ranks >> np.uint64(29)), axis=0)].reshape(RUN_FILTERS, RUN_ORDERS)
            x = np.arange(1, FILTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for y, prefixes in ((x[:WORD_FILTERS], first), (x[WORD_FILTERS:], run)):
                for k in range(prefixes.shape[1]):
                    y ^= prefixes[:, k]
                    y *= np.uint64(0xD6E8FEB86659FD93)
                    y ^= y >> np.uint64(32)
        return x.view(np.int64)


def with_filters(texts: DataFrame, column: str, common: dict[str, float]) -> DataFrame:
    """``texts`` with ``keys``, the filter hashes of ``column`` (as from ``words_text``), and ``n``, its words, in its place.

    Rows without a word are left out here, as a filter before would evaluate the text's expression once more.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)
    n = FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(shared.value)
        for b in batches:
            b = b.filter(pc.not_equal(b.column(column), ""))
            words = [s.split() for s in b.column(column).to_pylist()]
            rows = [orders.filters(w) for w in words]
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            keep = [i for i, f in enumerate(b.schema.names) if f != column]
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], keys, pa.array(map(len, words), pa.int32())], [*[b.schema.names[i] for i in keep], "keys", "n"])

    shape = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != column) + ", keys array<bigint>, n int"
    return texts.mapInArrow(run, shape)


def overlap(a: list[str], b: list[str]) -> float:
    """Words in common, counted with repeats, over the longer list; 0 where either is empty."""
    if not a or not b:
        return 0.0
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b))


def verified(pairs: DataFrame, texts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Those ``pairs`` (a, b) whose texts overlap by at least the limit in each column of ``limits``.

    ``texts`` has id and one ``words_text`` column for each limit. Only texts that a pair names are moved.
    """
    cols = list(limits)
    a = texts.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = texts.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in cols:
                x, y = batch.column(f"a_{c}").to_pylist(), batch.column(f"b_{c}").to_pylist()
                for i in np.flatnonzero(keep):
                    keep[i] = x[i] == y[i] != "" or overlap(x[i].split(), y[i].split()) >= limits[c]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in ("a", "b")], ["a", "b"])

    kind = dict(texts.dtypes)["id"]
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, f"a {kind}, b {kind}")


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def _distinct(marked: DataFrame, *digests: str) -> tuple[DataFrame, DataFrame]:
    """``marked`` rows whose digests certainly occur once, and the others; only the latter need a shuffle."""
    tested = possible_repeats(marked.withColumn("h", F.xxhash64(*digests))).drop("h")
    return tested.where("not repeat").drop("repeat"), tested.where("repeat").drop("repeat")


def salted(entries: DataFrame) -> DataFrame:
    """``entries`` (k, id, n) with ``salt`` and ``hub``; buckets of much more than ``PORTION`` rows have several salts and a hub, the smallest id.

    Which buckets are so large is estimated from one id in ``PROBE``. It settles how the work is divided, not what is compared.
    """
    probe = entries.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(PROBE)) == 0).groupBy("k").agg(F.count("*").alias("c")).where(f"c > {2 * PORTION // PROBE}")
    large = materialize(probe.select("k", F.ceil(F.col("c") * PROBE / PORTION).alias("salts")), "large")
    if large.isEmpty():
        return entries.withColumns({"salt": F.lit(0), "hub": F.lit(None).cast(f"struct<id:{dict(entries.dtypes)['id']},n:int>")})
    hubs = entries.join(large, "k").groupBy("k").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("salts").alias("salts"))
    spot = F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce("salts", F.lit(1))).cast("int")
    return entries.join(materialize(hubs, "hubs"), "k", "left").select("k", "id", "n", spot.alias("salt"), "hub")


def _named(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of ``source`` whose id a pair names."""
    return semi_join(source, materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named"))


def near_groups(rows: DataFrame, key: str, column: str, second: str, limits: tuple[float, float] = (0.7, 0.7)) -> DataFrame:
    """(id, member): groups closed over links, id the smallest of the group and member each other one.

    Two rows are linked if ``column`` and ``second`` (a JSON object by its values) each overlap by the limits, or
    differ in format only. Rows with an id, and with a letter or digit in both columns, take part; repeated ids count
    once, extra columns are ignored, and an empty table gives an empty result. Copies collapse first, so that a group of copies costs one text. In
    a bucket of more than ``NEAR`` texts, all are held against its smallest and against their ``NEAR`` neighbours;
    those that this does not join to the smallest one's group are then held against all members of such buckets with
    which they share a prefix of ``second`` under several orders, so that many answers to one text are not all compared.
    """
    source = rows.select(F.col(key).alias("id"), column, second)
    forms = source.where("id is not null").select("id", words_text(F.col(column)).alias("w"), letters_by_field(F.col(second)).alias("second"))
    digests = forms.select("id", digest(F.replace("w", F.lit(" "), F.lit(""))).alias("d1"), digest(F.col("second")).alias("d2"), "w", (F.col("second") != "").alias("full"))
    common = common_words(source.select(words_text(F.col(column)).alias("w")), "w")
    marked = materialize(with_filters(digests, "w", common).where("full").drop("full"), "marked")

    single, repeated = _distinct(marked, "d1", "d2")
    ids = repeated.groupBy("d1", "d2", "id").agg(F.lit(1).alias("one"))
    first = materialize(ids.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "first")
    copies = ids.join(first.where("n > 1"), ["d1", "d2"]).where("id > rep").select("id", "rep")
    chosen = repeated.groupBy("d1", "d2").agg(F.min_by(F.struct("keys", "n"), "id").alias("x"), F.min("id").alias("id")).select("id", "x.*")
    reps = single.select("id", "keys", "n").unionByName(chosen)

    entries = salted(reps.select(F.explode("keys").alias("k"), "id", "n"))
    part = "partition by k, salt order by id"
    buckets = entries.select(
        "k", "id", "n", F.expr(f"collect_list(struct(id, n)) over ({part} rows between 1 following and {NEAR} following)").alias("next"),
        F.coalesce("hub", F.expr(f"first_value(struct(id, n)) over ({part} rows between unbounded preceding and current row)")).alias("hub"),
        F.expr(f"row_number() over ({part})").alias("nth"), (F.col("hub").isNotNull() | F.expr(f"lead(id, {NEAR + 1}) over ({part}) is not null")).alias("more"),
    )
    buckets = buckets.withColumn("hot", F.expr(f"more or nth > {NEAR + 1}")).where("size(next) > 0 or hot")
    buckets = materialize(buckets.select("k", "id", "n", "next", "hub", "hot"), "buckets")
    alike = f"least(n, m) >= {limits[0]} * greatest(n, m)"  # texts of lengths further apart cannot overlap that much
    pairs = buckets.select(F.col("id").alias("a"), "n", F.explode("next").alias("x")).select("a", "n", F.col("x.id").alias("b"), F.col("x.n").alias("m"))
    pairs = pairs.unionByName(buckets.where("hot and hub.id <> id").select(F.col("hub.id").alias("a"), "n", F.col("id").alias("b"), F.col("hub.n").alias("m")))
    pairs = materialize(pairs.where(alike).select("a", "b").distinct(), "pairs")

    def check(some: DataFrame) -> DataFrame:
        texts = _named(some, source).dropDuplicates(["id"]).select("id", words_text(F.col(column)).alias("w1"), words_of_values(F.col(second)).alias("w2"))
        return verified(some, materialize(texts, "texts"), {"w1": limits[0], "w2": limits[1]})

    links = materialize(check(pairs), "links")
    roots = components(links)
    hot = buckets.where("hot").select("k", "id", "n", F.col("hub.id").alias("hub"))
    if not hot.isEmpty():
        root = lambda of: roots.select(F.col("id").alias(of), F.col("root").alias(f"root_{of}"))
        placed = hot.join(root("id"), "id", "left").join(root("hub"), "hub", "left")
        placed = materialize(placed.select("k", "id", "n", F.coalesce("root_id", "id").alias("r"), F.coalesce("root_hub", "hub").alias("h")), "placed")
        # of rows whose ``column`` is alike, those left apart must share a prefix of ``second`` too, under several orders again
        both = placed.groupBy("id").agg(F.first("r").alias("r"), F.max(F.col("r") != F.col("h")).alias("apart"))
        told = semi_join(source, materialize(both.select("id"), "hot")).dropDuplicates(["id"]).select("id", words_of_values(F.col(second)).alias("w"))
        told = materialize(told, "told")
        keyed = with_filters(told, "w", common_words(told.select("w"), "w")).join(both, "id").select(F.explode("keys").alias("k"), "id", "n", "r", "apart")
        keyed = materialize(keyed, "keyed")
        apart = keyed.where("apart").select("k", F.col("id").alias("a"), F.col("n").alias("m"), F.col("r").alias("ra"))
        more = apart.join(keyed.select("k", F.col("id").alias("b"), "n", F.col("r").alias("rb")), "k").where(f"ra <> rb and least(n, m) >= {limits[1]} * greatest(n, m)")
        more = materialize(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
        links = materialize(links.unionByName(check(more)), "links")
        roots = components(links)
    of_rep = roots.where("id <> root").select(F.col("id").alias("rep"), "root")
    moved = copies.join(of_rep, "rep", "left").select(F.coalesce("root", "rep").alias("id"), F.col("id").alias("member"))
    return moved.unionByName(of_rep.select(F.col("root").alias("id"), F.col("rep").alias("member")))


def cross_split_classes(rows: DataFrame, key: str = "example_id", split: str = "split_name", column: str = "context", second: str = "instruction", limits: tuple[float, float] = (0.7, 0.6)) -> tuple[DataFrame, DataFrame]:
    """Classes of rows with the same words, and which classes overlap: (t, d2, split, id) of each member, and (a, d2_a, b, d2_b) of each pair
    of a class with members in val or test and one with members in train.

    Canonicalised texts (case, punctuation and white space removed) are hashed: equal hashes join the copies, equal
    filter hashes of the canonical words join what is nearly the same. Distinct texts of ``column`` are held against
    each other once, then distinct pairs of ``second``, so groups of copies cost no more than one text. Rows whose ``column`` or ``second`` has no word, or whose split is null or another, take
    no part. Repeated ids count once; extra columns are ignored; empty tables give an empty result.
    """
    source = rows.select(F.col(key).alias("id"), F.col(split).alias("split"), F.col(column).alias("text"), F.col(second).alias("other"))
    source = source.where(F.col("id").isNotNull() & F.col("split").isin("train", "val", "test"))
    canon = source.select("id", "split", words_text(F.col("text")).alias("w"), words_text(F.col("other")).alias("o"))
    canon = canon.select("id", "split", digest(F.col("w")).alias("d1"), digest(F.col("o")).alias("d2"), "w", (F.col("o") != "").alias("full"))
    common = common_words(source.select(words_text(F.col("text")).alias("w")), "w")
    marked = materialize(with_filters(canon, "w", common).where("full").drop("full"), "marked")

    train = F.col("split") == "train"
    single, repeated = _distinct(marked, "d1")
    sides = [F.max(train).alias("in_train"), F.max(~train).alias("in_eval")]
    chosen = materialize(repeated.groupBy("d1").agg(F.min("id").alias("t"), F.min_by("keys", "id").alias("keys"), F.min("n").alias("n"), *sides), "chosen")
    groups = single.select("d1", F.col("id").alias("t"), "keys", "n", train.alias("in_train"), (~train).alias("in_eval")).unionByName(chosen)
    entries = materialize(groups.select(F.explode("keys").alias("k"), F.col("t").alias("id"), "n", "in_train", "in_eval"), "entries")
    left = entries.where("in_eval").select("k", F.col("id").alias("a"), "n")
    right = entries.where("in_train").select("k", F.col("id").alias("b"), F.col("n").alias("m"))
    pairs = left.join(right, "k").where(f"a <> b and least(n, m) >= {limits[0]} * greatest(n, m)")
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    texts = _named(pairs, source).dropDuplicates(["id"]).select("id", words_text(F.col("text")).alias("w1"))
    close = verified(pairs, materialize(texts, "texts"), {"w1": limits[0]})
    same = chosen.where("in_train and in_eval").select(F.col("t").alias("a"), F.col("t").alias("b"))
    close = materialize(close.unionByName(same), "close")

    lone = single.select(F.col("id").alias("t"), "d2", "split", "id")
    shared = repeated.groupBy("d1", "d2", "split", "id").agg(F.lit(1).alias("one")).join(chosen.select("d1", "t"), "d1").select("t", "d2", "split", "id")
    wanted = materialize(close.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    members = lone.unionByName(shared).withColumnsRenamed({"id": "member", "t": "id"})
    members = materialize(semi_join(members, wanted).withColumnsRenamed({"id": "t", "member": "id"}), "members")
    kinds = members.groupBy("t", "d2").agg(F.min("id").alias("i"), F.max(train).alias("in_train"), F.max(~train).alias("in_eval"))
    ev = kinds.where("in_eval").select(F.col("t").alias("a"), F.col("d2").alias("d2_a"), F.col("i").alias("i_a"))
    tr = kinds.where("in_train").select(F.col("t").alias("b"), F.col("d2").alias("d2_b"), F.col("i").alias("i_b"))
    met = materialize(close.join(ev, "a").join(tr, "b"), "met")
    kind = members.groupBy("d2").agg(F.min("id").alias("id"))
    other = _named(kind.select(F.col("id").alias("a"), F.col("id").alias("b")), source).dropDuplicates(["id"]).select("id", words_text(F.col("other")).alias("w2"))
    other = materialize(other.join(kind, "id"), "other")
    asked = met.select("d2_a", "d2_b").distinct()
    ids = kind.select(F.col("d2").alias("d2_a"), F.col("id").alias("a"))
    asked = asked.join(ids, "d2_a").join(ids.select(F.col("d2_a").alias("d2_b"), F.col("a").alias("b")), "d2_b")
    alike = verified(asked.select("a", "b"), other.select("id", "w2"), {"w2": limits[1]})
    alike = asked.join(alike, ["a", "b"]).select("d2_a", "d2_b")
    met = met.join(alike, ["d2_a", "d2_b"]).select("a", "b", "d2_a", "d2_b")
    return members, met


def cross_split_pairs(rows: DataFrame, **options) -> DataFrame:
    """(train_id, eval_id, eval_split): rows of val or test that a train row repeats, the same or nearly so, each pair listed; see ``cross_split_classes``."""
    members, met = cross_split_classes(rows, **options)
    train = F.col("split") == "train"
    e = members.where(~train).select(F.col("t").alias("a"), F.col("d2").alias("d2_a"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    t = members.where(train).select(F.col("t").alias("b"), F.col("d2").alias("d2_b"), F.col("id").alias("train_id"))
    return met.join(e, ["a", "d2_a"]).join(t, ["b", "d2_b"]).select("train_id", "eval_id", "eval_split")


def cross_split_links(rows: DataFrame, **options) -> DataFrame:
    """(id, split, class_id, links) of each row that overlaps with one of the other side: the smallest id of its class, and how many rows of
    the other side it overlaps with. Nothing is listed pair by pair, so a class that holds a third of all rows costs its own rows only.
    """
    members, met = cross_split_classes(rows, **options)
    train = F.col("split") == "train"
    sizes = members.groupBy("t", "d2").agg(F.min("id").alias("class_id"), F.count_if(train).alias("trained"), F.count_if(~train).alias("held_out"))
    side = lambda x, y, n: met.join(sizes.select(F.col("t").alias(y), F.col("d2").alias(f"d2_{y}"), F.col(n).alias("n")), [y, f"d2_{y}"]).groupBy(F.col(x).alias("t"), F.col(f"d2_{x}").alias("d2")).agg(F.sum("n").alias("links"))
    links = side("a", "b", "trained").withColumn("trained_side", F.lit(False)).unionByName(side("b", "a", "held_out").withColumn("trained_side", F.lit(True)))
    links = links.join(sizes.select("t", "d2", "class_id"), ["t", "d2"]).where("links > 0")
    return members.withColumn("trained_side", train).join(links, ["t", "d2", "trained_side"]).select("id", "split", "class_id", "links")


def overlap_report(links: DataFrame, rows: DataFrame, key: str = "example_id", split: str = "split_name", source: str = "source") -> DataFrame:
    """Per split and source: evaluation rows, those that overlap with train, and the overlapping pairs; ``links`` as from ``cross_split_links``."""
    hits = links.where("split <> 'train'").select(F.col("id").alias("eval_id"), "links")
    base = rows.where(F.col(split).isin("val", "test")).groupBy(F.col(key).alias("eval_id")).agg(F.min(split).alias("split_name"), F.min(source).alias("source"))
    out = base.join(hits, "eval_id", "left").groupBy("split_name", "source")
    return out.agg(F.count("*").alias("eval_rows"), F.count("links").alias("overlapping_rows"), F.coalesce(F.sum("links"), F.lit(0)).alias("pairs"))
