"""Near copies by the Jaccard similarity of word shingles, found by covering masks at the radius that the similarity sets.

A text's set: A-Z in lower case, its words, shingles of ``WIDTH`` words (all words if there are fewer), 64-bit hashes.

The set is a binary vector with a place for every shingle, and a mask keeps one place that is set. Sets of n and m shingles whose similarity is
``NUM / DEN`` or more share at least a = (n + m) * NUM / (NUM + DEN) of them, so in any order that all sets have in common the
first shared shingle stands at place n - a or before: sets of one size differ in a ninth of their shingles at most, and a set is
entered under its first n / 5, which covers smaller partners too. So every similar pair meets under some mask. The order
puts shingles that are frequent in a sample of texts last: a passage that many texts hold falls behind a text's own words, and sets meet at it only if
they have hardly any. Another sample gives the same pairs.

Work goes by distinct set: copies are one class whatever their number. Sets whose SimHash fingerprints lie within op4's radius, found by its covering
masks, are candidates first. A similarity of 0.8 may leave fingerprints further apart, so the sets' own masks find the rest. Where at most ``SMALL`` sets meet, all pairs that
can still be similar are candidates. Where more meet, each is first compared with one of them; then pairs of sets that no
chain of links joins yet are compared, by blocks of rows spread over tasks, unless the parities of their shingles by places differ in more
places than the sets may in shingles. Candidates pass the same parities, and are then verified on the whole sets, which are
made again from the texts. Nothing is capped and no pair is missed.

Defined cases: as in ``simhash``; texts without words are equal sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm import simhash
from rillstone.llm.components import components
from rillstone.llm.store import Scratch, bounded_batches, join_split, materialize, small

WIDTH = 5
NUM, DEN = 4, 5
SMALL = 8
SAMPLE, OFTEN, LISTED = 10_000, 5, 100_000
PART, KNOWN = 4, 1_000_000
BLOCK, SPREAD, ALONE = 64, 16, 2
PAIRS = 1000
BITS, BRIEF = 512, 1 << 15
HELD = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles, ascending; places in the common order, after all shingles that aren't among them; above which place they are in so many sets that their rows are dealt out.
Often = tuple[np.ndarray, np.ndarray, int]
_PRINTS = "doc_id long, text_hash long, sig long, n int, bits binary, brief binary, fp long, cold int, keys array<long>"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The set of a text's shingles as ascending unsigned hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    k = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    last = len(words) - k + 1
    out = np.full(last, k, np.uint64)
    for i in range(k):
        out = _mixed(out ^ h[i : i + last])
    return np.unique(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def radius(a: int, b: int) -> int:
    """In how many shingles similar sets of these sizes may differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def keys(found: np.ndarray, often: Often, share: int = DEN) -> tuple[np.ndarray, int]:
    """The shingles a set is entered under, the first ``share``-th part in the common order and one, with the number of those before the first that stands above ``often``'s floor."""
    known, counts, floor = often
    times = np.zeros(len(found), np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, found), len(known) - 1)
        times = np.where(known[i] == found, counts[i], 0)
    first = np.lexsort((_mixed(found), times))[: len(found) * (DEN - NUM) // share + 1]
    return found[first], int((times[first] <= floor).sum())


def parities(found: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls on each place; two sets differ in at least as many shingles as places."""
    size = max(BITS, 1 << (2 * len(found)).bit_length())
    at = (found & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(bool)).tobytes()


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set, as a signed long: a bit is 1 if more than half the shingles set it."""
    ones = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def folded(bits: memoryview | bytes, size: int) -> np.ndarray:
    """Parities over fewer places, as words of 64 bits."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 64 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def brief(bits: bytes, n: int) -> bytes:
    """Parities of a set of n shingles over n to 2 * n places (``BRIEF`` at most): enough to tell sets apart that share half."""
    return folded(bits, min(BRIEF, max(BITS // 2, 1 << n.bit_length()))).tobytes()


def _frequent(texts: DataFrame) -> Often:
    """Shingles, ascending, and counts of those in at least ``OFTEN`` of about ``SAMPLE`` texts; the ``LISTED`` most frequent. Below them, where that is a smaller sample,
    those which stand at the front of ``OFTEN`` sets in every ``PART``-th text; the ``KNOWN`` most frequent. So a key that isn't known is in few sets however many texts there are."""

    def counted(part: int, most: int, often: Often | None) -> tuple[np.ndarray, np.ndarray]:
        shared = texts.sparkSession.sparkContext.broadcast(often)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in b.column(0).to_pylist():
                    found = shingles(t)
                    if shared.value is not None:
                        first, cold = keys(found, shared.value, 3)
                        found = first[:cold]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

        some = texts.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(part)) == 0).select("text")
        counts = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(f"n >= {OFTEN}")
        rows = counts.orderBy(F.desc("n"), "key").limit(most).toArrow()
        return rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()

    def ascending(found: np.ndarray, n: np.ndarray, floor: int) -> Often:
        order = np.argsort(found)
        return found[order], n[order], floor

    part = max(1, texts.count() // SAMPLE)
    first = counted(part, LISTED, None)
    if part <= PART:
        return ascending(*first, 0)
    more = counted(PART, KNOWN, ascending(*first, 0))
    floor = int(more[1].max(initial=0))
    return ascending(np.concatenate([first[0], more[0]]), np.concatenate([first[1] + floor, more[1]]), floor)


def _prints(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, sig (a hash of the set), n (its size), bits (its parities), brief (over fewer places), fp (its SimHash) and keys of every row, of
    which the first ``cold`` aren't among the ``LISTED``."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            sig = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            each = [keys(s, shared.value) for s in sets]
            flat = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in each)]).view(np.int64)
            ends = pa.array(np.cumsum([0, *(len(k) for k, _ in each)]), pa.int32())
            bits = [parities(s) for s in sets]
            columns = [b.column(0), b.column(1), pa.array(sig), pa.array([len(s) for s in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array([brief(x, len(s)) for x, s in zip(bits, sets, strict=True)], pa.binary()), pa.array(list(map(fingerprint, sets)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in each], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat))], names=[x.split()[0] for x in _PRINTS.split(", ")])

    return texts.mapInArrow(run, _PRINTS)


def _may(x: Column, y: Column) -> Column:
    """Whether two sets that first meet here, at places p, can be similar enough."""
    sizes = F.least(x["n"], y["n"]) * DEN >= F.greatest(x["n"], y["n"]) * NUM
    return sizes & (F.least(x["n"] - x["p"], y["n"] - y["p"]) * (NUM + DEN) >= (x["n"] + y["n"]) * NUM)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose parities differ in no more places than their sets may in shingles."""
    for b in batches:
        good = []
        for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
            x, y = x.as_buffer(), y.as_buffer()
            size = 8 * min(len(x), len(y))
            good.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= radius(n, m))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are similar enough."""
    for b in batches:
        good = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)]), kind="stable")
            good.append((NUM + DEN) * int((both[1:] == both[:-1]).sum()) >= NUM * len(both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["sig", "grams"])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, into: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    step = Scratch(pairs.sparkSession)

    def ends(pairs: DataFrame) -> DataFrame:
        """The sets in pairs with the number of their pairs in ``rows``; a set may be in most of them."""
        return classes.drop("rows").join(pairs.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("rows")), "sig")

    pairs = step.write(pairs.distinct(), "met")
    known = step.write(ends(pairs).select("sig", "n", "bits", "rows"), "ends")
    for end in "ab":
        pairs = join_split(pairs, known.select(F.col("sig").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}"), "rows"), end)
    pairs = step.write(pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_plausible, "a long, b long"), "candidates")
    wanted = step.write(ends(pairs).select("sig", "rows", F.col("from.doc_id").alias("id"), F.col("from.text_hash").alias("hash")), "wanted")
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    made = texts.join(small(wanted), match).select("sig", "text").mapInArrow(_sets, "sig long, grams binary")
    made = step.write(made.dropDuplicates(["sig"]), "sets")
    salts = wanted.select("sig", F.explode(F.sequence(F.lit(0), F.floor(F.col("rows") / PAIRS).cast("int"))).alias("salt"), "rows")
    made = made.join(salts, "sig")  # a set for every PAIRS of its pairs
    for end, other in ("ab", "ba"):
        of = wanted.select(F.col("sig").alias(end), "rows", F.floor(F.col("rows") / PAIRS).alias("last"))
        pairs = join_split(pairs, of, end).withColumn(f"salt{end}", F.pmod(F.xxhash64(other), F.col("last") + 1).cast("int")).drop("last")
    for end in "ab":
        pairs = pairs.join(made.select(F.col("sig").alias(end), F.col("salt").alias(f"salt{end}"), F.col("grams").alias(f"grams{end}")), [end, f"salt{end}"])
    found = into.write(pairs.select("a", "b", "gramsa", "gramsb").mapInArrow(_similar, "a long, b long"), "verified")
    step.clear()
    return found


def _by_fingerprint(classes: DataFrame, step: Scratch) -> DataFrame:
    """Pairs (a, b) of sets that op4's covering masks bring together: of fingerprints within its radius the least sets, and each set with the least of its fingerprint."""
    heads = step.write(classes.groupBy("fp").agg(F.min("sig").alias("head"), F.count("*").alias("rows")), "heads")
    pairs = simhash.links(heads.select("fp"), into=step)
    for end in "ab":
        pairs = pairs.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"head{end}")), end)
    across = pairs.select(F.least("heada", "headb").alias("a"), F.greatest("heada", "headb").alias("b"))
    same = join_split(classes.select("sig", "fp"), heads, "fp").filter("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    return across.unionByName(same)


def _pairs(f: Column) -> Column:
    """Pairs of an array's sets that can be similar, the lesser sig first."""
    end = lambda x, y: F.struct(x["sig"].alias("a"), y["sig"].alias("b"))
    return F.flatten(F.transform(f, lambda x: F.transform(F.filter(f, lambda y: (x["sig"] < y["sig"]) & _may(x, y)), lambda y: end(x, y))))


def _block(rows: pa.Array) -> tuple[dict[str, np.ndarray], list[bytes]]:
    columns = {k: rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("sig", "n", "p", "c")}
    return columns, [x.as_buffer() for x in rows.field("brief")]


def _open(x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in two blocks of the pairs of sets that can be similar and are in different components, with the share of their sets' radius that their parities differ by;
    a pair of sets of one block (x is y) once, otherwise those of which the smaller is in x. Parities are compared over the places of the smaller set's."""
    (one, w), (two, v) = x, y
    lengths, others = np.array(list(map(len, w))), np.array(list(map(len, v)))
    for size in np.unique(lengths):
        i, j = np.nonzero(lengths == size)[0], np.nonzero((others >= size) & (others <= 4 * size))[0]
        n, n2 = one["n"][i][:, None], two["n"][j]
        may = (one["c"][i][:, None] != two["c"][j]) & (np.minimum(n - one["p"][i][:, None], n2 - two["p"][j]) * (NUM + DEN) >= (n + n2) * NUM)
        may &= (n < n2) | ((n == n2) & (one["sig"][i][:, None] < two["sig"][j])) if x is y else one["sig"][i][:, None] != two["sig"][j]
        p, q = np.nonzero(may)
        if not len(p):
            continue
        wide, wide2 = (np.stack([folded(m, 8 * int(size)) for m in (k[at] for at in t)]) for k, t in ((w, i), (v, j)))
        step = max(1, HELD // int(size))
        for lo in range(0, len(p), step):
            g, h = p[lo : lo + step], q[lo : lo + step]
            share = np.bitwise_count(wide[g] ^ wide2[h]).sum(axis=1, dtype=np.int64) * (NUM + DEN) / ((n[g, 0] + n2[h]) * (DEN - NUM))
            good = share <= 1
            yield i[g[good]], j[h[good]], share[good]


def _forest(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> list[int]:
    """Which of the pairs (a, b) of components join what no pair that is more alike has joined."""
    top: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := top.get(k, k)) != k:
            top[k] = k = top.get(up, up)
        return k

    out = []
    for k in np.argsort(share, kind="stable").tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            top[x] = y
            out.append(k)
    return out


def _across(batches: Iterator[pa.RecordBatch], spanning: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of two blocks' sets, or of one's, that can be similar and are in different components, with the blocks' key; if ``spanning``, only those that
    join components which no pair that is more alike joins, so fewer than there are sets."""
    for b in batches:
        for key, f, f2 in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            x = _block(f.values)
            y = _block(f2.values) if f2.is_valid else x
            found = list(_open(x, y))
            i, j, share = (np.concatenate([np.zeros(0, t), *(p[k] for p in found)]) for k, t in enumerate((np.int64, np.int64, float)))
            if spanning:
                told = _forest(x[0]["c"][i], y[0]["c"][j], share)
                i, j = i[told], j[told]
            ends = np.sort(np.stack([x[0]["sig"][i], y[0]["sig"][j]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(np.full(len(i), key, np.int64))], names=["a", "b", "key"])


def _met(prints: DataFrame) -> DataFrame:
    """sig, n, p, key of every set that meets others at a key, with their number m and one of them, head, that is entered early enough to
    be the smaller of a pair; keys without such a set are left out.

    The rows under a key are counted in one shuffle of all keys. Those of a listed key are counted by salts, and the
    salts' counts, one row a listed key, are broadcast.
    """
    salts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    one = prints.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "cold", "keys")])
    rows = one.select("sig", "n", "cold", F.posexplode("keys").alias("p", "key"))
    rows = rows.select("sig", "n", "p", "key", (F.col("p") >= F.col("cold")).alias("hot"))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sig"), F.lit(salts))).otherwise(0).cast("int"))
    here = Window.partitionBy("key", "salt")
    early = F.col("p") * (NUM + DEN) <= F.col("n") * (DEN - NUM)
    rows = rows.withColumn("m", F.count("*").over(here)).withColumn("head", F.min(F.when(early, F.struct("sig", "n", "p"))).over(here))
    return rows.filter("hot or (m > 1 and head is not null)")


def _bucket(n: Column) -> Column:
    """Sets of sizes within a twentieth or so of each other."""
    return F.floor(F.log(n) * 20).cast("int")


def _sides(rows: DataFrame) -> DataFrame:
    """rows with early (a set can be the smaller of a pair that first meets here) and the least and most size of a smaller partner; those that can be neither left out."""
    n, p = F.col("n"), F.col("p")
    least = F.ceil(n * NUM / DEN)
    most = F.least(n, F.floor((n - p) * (NUM + DEN) / NUM) - n)  # (n - p) * (NUM + DEN) >= NUM * (n + partner)
    rows = rows.withColumns({"early": p * (NUM + DEN) <= n * (DEN - NUM), "least": least, "most": most})
    return rows.filter("early or most >= least")


def _block_pairs(rows: DataFrame, classes: DataFrame, step: Scratch) -> DataFrame:
    """key, f, f2: blocks of sets of which each pair that can be similar is in one (f2 is null) or in two, the smaller set in f.

    The sets under a key are one block if they are at most ``ALONE`` * ``BLOCK``. Where more meet, a set is entered as the smaller in the bucket of its size if its place allows it, and as the
    larger in the buckets of all sizes that its size and place leave to a partner. So sets that meet at a late place, where no partner is small enough, meet no other. Blocks of the
    larger sets are dealt to tasks by groups, each with all blocks of the smaller."""
    rows = _sides(rows)
    open_ = rows.groupBy("key").agg(F.count("*").alias("held"), F.count("*").alias("rows"), F.max("early").alias("early"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    open_ = step.write(open_.filter("early and lo < hi").select("key", "held", "rows"), "open_keys")
    rows = step.write(join_split(rows, open_, "key"), "rows")
    brief = classes.select("sig", "brief")
    item = F.struct("sig", "n", "p", "c", "brief")
    alone = rows.filter(F.col("held") <= ALONE * BLOCK).join(brief, "sig").groupBy("key").agg(F.collect_list(item).alias("f"))
    alone = alone.select("key", "f", F.lit(None).cast(alone.schema["f"].dataType).alias("f2"))
    rows = rows.filter(F.col("held") > ALONE * BLOCK)
    if rows.isEmpty():
        return alone
    early = F.when(F.col("early"), F.array(F.struct(F.lit(0).alias("side"), _bucket(F.col("n")).alias("bucket"))))
    late = F.when(F.col("most") >= F.col("least"), F.transform(F.sequence(_bucket(F.col("least")), _bucket(F.col("most"))), lambda b: F.struct(F.lit(1).alias("side"), b.alias("bucket"))))
    none = F.array().cast("array<struct<side:int,bucket:int>>")
    entered = rows.select("key", "sig", "n", "p", "c", F.explode(F.concat(F.coalesce(early, none), F.coalesce(late, none))).alias("e")).select("key", "sig", "n", "p", "c", "e.*")
    entered = step.write(entered.withColumns({"at": F.xxhash64("key", "bucket"), "of": F.xxhash64("key", "bucket", "side")}), "entered")
    # only where a smaller set stands and not all are linked already
    open_ = entered.groupBy("at").agg(F.count("*").alias("rows"), F.min("side").alias("side"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("side = 0 and lo < hi")
    entered = step.write(join_split(entered, step.write(open_.select("at", "rows"), "open"), "at").drop("at"), "entered")
    counts = entered.groupBy("of").agg(F.count("*").alias("rows"), F.count("*").alias("m"))
    sized = join_split(entered, step.write(counts, "counts"), "of").withColumn("k", F.pmod(F.xxhash64("sig"), F.ceil(F.col("m") / BLOCK)))
    blocks = sized.join(brief, "sig").groupBy("key", "bucket", "side", "m", "k").agg(F.collect_list(item).alias("f"))
    blocks = step.write(blocks, "blocks")
    large = blocks.filter("side = 1").select("key", "bucket", F.floor(F.col("k") / SPREAD).cast("int").alias("g"), F.col("f").alias("f2"))
    groups = large.groupBy("key", "bucket").agg(F.max("g").alias("last"))
    small_ = blocks.filter("side = 0").join(groups, ["key", "bucket"]).select("key", "bucket", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("g"), "f")
    return alone.unionByName(small_.join(large, ["key", "bucket", "g"]).select("key", "f", "f2"))


def links(classes: DataFrame, met: DataFrame, texts: DataFrame, into: Scratch, most: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct sets whose components are those of all pairs of similar sets; written into the tables given."""
    step = Scratch(classes.sparkSession)
    met = step.write(met, "buckets")
    totals = F.broadcast(met.filter("hot").groupBy("key").agg(F.count("*").alias("m"), F.min("head").alias("head")))  # at most LISTED rows
    columns = ["sig", "n", "p", "key", "m", "head"]
    met = met.filter("not hot").select(*columns).unionByName(met.filter("hot").drop("m", "head").join(totals, "key").filter("m > 1 and head is not null").select(*columns))
    item = F.struct("sig", "n", "p")
    few = met.filter(F.col("m") <= most).groupBy("key").agg(F.collect_list(item).alias("f"))
    few = few.select(F.explode(_pairs(F.col("f"))).alias("l")).select("l.*")
    many = met.filter(F.col("m") > most)
    star = many.filter((F.col("sig") != F.col("head.sig")) & _may(F.col("head"), item)).select(F.least("head.sig", "sig").alias("a"), F.greatest("head.sig", "sig").alias("b"))
    first = _verified(few.unionByName(star).unionByName(_by_fingerprint(classes, step)), classes, texts, into)
    found = first
    for spanning in (True, False):
        reach = components(found, step)
        named = many.join(reach, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "p", F.coalesce("component", "sig").alias("c"))
        both = _block_pairs(step.write(named, "named"), classes, step)
        rest = step.write(both.mapInArrow(functools.partial(_across, spanning=spanning), "a long, b long, key long"), "rest")
        found = found.unionByName(_verified(rest.select("a", "b"), classes, texts, into))
        many = many.join(small(step.write(rest.select("key").distinct(), "again")), "key", "left_semi")  # elsewhere no pair is left
    step.clear()
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, component_id (the smallest doc_id reachable, itself included)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    step = Scratch(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = step.write(_prints(texts), "prints")
    classes = prints.groupBy("sig").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("from"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("brief").alias("brief"), F.first("fp").alias("fp")
    )
    classes = step.write(classes, "classes")
    reach = components(links(classes, _met(prints), texts, step), step)
    named = classes.join(reach, classes.sig == reach.node, "left").select("sig", "rows", "least", F.coalesce("component", "sig").alias("component"))
    named = step.write(named, "named")
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = step.write(named.join(heads, "component").select("sig", "rows", "component_id"), "of")
    told = materialize(join_split(prints.select("doc_id", "text_hash", "sig"), of, "sig").select("doc_id", "text_hash", "component_id"), "groups")
    step.clear()
    return told


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of a component other than its smallest id, as ``simhash.drop_near`` has it."""
    return simhash.without(docs, near_groups(docs, id_col, text_col), id_col, text_col)
