"""Phrase collocations by mergeable Misra-Gries summaries.

Texts (A-Z in lower case) are cut into pieces and those into words; phrases of up to ``LONGEST`` words are counted per language.

1. Every task turns the phrases of some million words into hashes with counts and deals them out by hash partition. A partition's
   counts are merged into one Misra-Gries summary: when it has more than ``capacity`` entries, what the entry beyond the
   last has is taken from all. A capacity above the partition's mass divided by the threshold takes less than the
   threshold in all, so every frequent phrase survives, and an entry counts as a survivor if its count and what was taken reach the threshold. The
   capacity follows from the size of the texts; should a partition get more than its share, its summary grows rather than lose a phrase.
2. A Bloom filter of the survivors, of at most ``FILTER_BYTES``, goes to all tasks. They count the phrases that pass it, as
   text; what passes by chance, or by a hash that two phrases share, is counted exactly too and falls below the threshold.

Scores, cuts and containment are joins of the counts. A first part that is in many phrases is joined map-side.

Defined cases: a null text is empty; null languages are ``und``, together with those that are called so; repeated rows count as
often as they come; a text of any length is taken in slices; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, bounded_batches, join_split, materialize

LONGEST, OFTEN, SHARE, TOP = 3, 10, 50, 2000
WORDS_A_FLUSH, SLICE, PART_BYTES, FILTER_BYTES, BITS_AN_ENTRY, PROBES = 1_000_000, 1 << 20, 64 << 20, 32 << 20, 16, 4
#: Characters that end a piece, and the tab, as what they are read as.
_READ_AS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_MIX, _LOW48 = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 48) - 1)


class _Ids(dict):
    """Numbers for words as they come: 0 is the end of a piece, 1 the empty word between two spaces."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(text: str | None, ids: _Ids) -> list[np.ndarray]:
    """The words of a text as numbers, slice by slice, with an end of piece last."""
    data = ((text or "").encode("utf-8", "surrogatepass").lower().translate(_READ_AS) + b"\n").replace(b"\n", b" \n ")
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        words = data[at:end].split(b" ")
        out.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        at = end + 1
    return out


def _counted(a: np.ndarray, k: int, n_ids: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of k words in a run of numbers, as a column a word, and their counts."""
    ok = np.ones(max(len(a) - k + 1, 0), bool)
    for i in range(k):
        ok &= a[i : i + len(ok)] > 1
    places = np.flatnonzero(ok)
    key, known = a[places], []
    for i in range(1, k):
        if n_ids ** (i + 1) >= 1 << 63:  # too many words for one number: number the phrases so far instead
            before, key = np.unique(key, return_inverse=True)
            known.append((i, before))
        key = key * n_ids + a[places + i]
    key, counts = np.unique(key, return_counts=True)
    columns = []
    for i in range(k - 1, 0, -1):
        columns.append(key % n_ids)
        key = key // n_ids
        if known and known[-1][0] == i:
            key = known.pop()[1][key]
    return [key, *columns[::-1]], counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> np.uint64(31))


class _Phrases:
    """Counts of phrases by language, of some million words at a time."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.ids, self.runs, self.size = _Ids(), {}, 0

    def add(self, lang: str, text: str | None) -> bool:
        """Whether it's time to count."""
        new = _numbered(text, self.ids)
        self.runs.setdefault(lang, []).extend(new)
        self.size += sum(map(len, new))
        return self.size >= WORDS_A_FLUSH

    def counted(self) -> Iterator[tuple[str, int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
        """language, words in it, k, word numbers, counts, 48-bit hashes."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), np.uint64, len(self.ids))
        for lang, runs in self.runs.items():
            a = np.concatenate(runs)
            a = a[a != 1]
            seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
            for k in range(1, self.longest + 1):
                columns, counts = _counted(a, k, len(self.ids))
                h = np.full(len(counts), seed, np.uint64)
                for c in columns:
                    h = _mixed(h ^ hashes[c]) + np.uint64(k)
                yield lang, int((a > 1).sum()), k, columns, counts, _mixed(h) & _LOW48


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(parts)) >> np.uint64(32)


def _packed(h: np.ndarray) -> np.ndarray:
    """48-bit hashes as rows of six bytes."""
    return np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unpacked(data: bytes) -> np.ndarray:
    rows = np.zeros((len(data) // 6, 8), np.uint8)
    rows[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return rows.view("<u8").ravel()


_DEALT = "part int, hashes binary, counts binary"


def _dealt(phrases: _Phrases, parts: int) -> pa.RecordBatch:
    """A row for each hash partition: the hashes of its phrases, those counted more than once first, with their counts."""
    found = [(h, n) for *_, n, h in phrases.counted()]
    h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
    n = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
    more = n > 1
    once, often, n = np.sort(h[~more]), h[more], n[more]
    order = np.argsort(often)
    often, n = often[order], n[order].astype("<u4")
    starts = np.arange(parts + 1, dtype=np.uint64)
    cut_once, cut_often = (np.searchsorted(_part(x, parts), starts) for x in (once, often))
    once, often = _packed(once), _packed(often)
    rows = [(p, often[cut_often[p] : cut_often[p + 1]].tobytes() + once[cut_once[p] : cut_once[p + 1]].tobytes(), n[cut_often[p] : cut_often[p + 1]].tobytes()) for p in range(parts)]
    columns = list(zip(*[r for r in rows if r[1]])) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["part", "hashes", "counts"])


class Summary:
    """A Misra-Gries summary: counts that are too low by at most ``lost``, which stays below the threshold."""

    def __init__(self, capacity: int, threshold: int) -> None:
        self.capacity, self.threshold, self.lost = capacity, threshold, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.n_waiting += len(hashes)
        if self.n_waiting > max(len(self.hashes), 1 << 18):
            self.merge()

    def merge(self) -> None:
        h = np.concatenate([self.hashes, *(x for x, _ in self.waiting)])
        n = np.concatenate([self.counts, *(x for _, x in self.waiting)])
        self.waiting, self.n_waiting = [], 0
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[1:] != h[:-1]]))
        h, n = h[first], np.add.reduceat(n, first) if len(first) else n
        if len(h) > self.capacity:
            cut = int(np.partition(n, len(n) - self.capacity - 1)[len(n) - self.capacity - 1])
            if self.lost + cut < self.threshold:
                self.lost += cut
                h, n = h[n > cut], n[n > cut] - cut
        self.hashes, self.counts = h, n

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.hashes[self.counts + self.lost >= self.threshold]


def _surviving(docs: DataFrame, longest: int, often: int, step: Scratch) -> tuple[DataFrame, int]:
    """part, n, hashes of the phrases that may be frequent, a row for each of the hash partitions; how many those are."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("decimal(38,0)"))).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // PART_BYTES) + 1)
    capacity = int(size + 1) * longest // (2 * parts * often) + 1  # a word has a character and a space at least

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _Phrases(longest)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if phrases.add(lang, text):
                    yield _dealt(phrases, parts)
                    phrases.clear()
        yield _dealt(phrases, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, None

        def row() -> pa.RecordBatch:
            h = summary.survivors()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([_packed(h).tobytes()], pa.binary())], names=["part", "n", "hashes"])

        for b in batches:
            for part, data, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if part != now:
                    if summary:
                        yield row()
                    now, summary = part, Summary(capacity, often)
                h, n = _unpacked(data.as_buffer()), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
                summary.add(h, np.concatenate([n, np.ones(len(h) - len(n), np.int64)]))
        if summary:
            yield row()

    dealt = docs.mapInArrow(deal, _DEALT).repartition("part").sortWithinPartitions("part")
    return step.write(dealt.mapInArrow(merge, "part int, n long, hashes binary"), "survivors"), parts


def _probes(h: np.ndarray, parts: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and bit of each probe in a filter of ``bits`` bits a partition."""
    base, x = _part(h, parts) * np.uint64(bits), _mixed(h)
    for _ in range(PROBES):
        x = _mixed(x + np.uint64(1))
        at = base + x % np.uint64(bits)
        yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def _filter(survivors: DataFrame, parts: int) -> tuple[np.ndarray, int]:
    """The survivors' Bloom filter, a stretch for each partition, and the bits of a stretch; all of it is at most ``FILTER_BYTES``."""
    total = survivors.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BYTES * 8 // parts, total * BITS_AN_ENTRY // parts * 5 // 4 + 64) // 8 * 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                stretch = np.zeros(bits // 8, np.uint8)
                for at, bit in _probes(_unpacked(data.as_buffer()), parts, bits):
                    np.bitwise_or.at(stretch, at - part * (bits // 8), bit)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([stretch.tobytes()], pa.binary())], names=["part", "bits"])

    whole = np.zeros(parts * bits // 8, np.uint8)
    for r in survivors.select("part", "hashes").mapInArrow(fill, "part int, bits binary").toLocalIterator():  # FILTER_BYTES in all
        whole[r["part"] * (bits // 8) : (r["part"] + 1) * (bits // 8)] = np.frombuffer(r["bits"], np.uint8)
    return whole, bits


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, often: int = OFTEN, into: Scratch | None = None) -> DataFrame:
    """lang, k, phrase, n of every phrase of up to longest words that occurs at least ``often`` times in its language, and n of all words of
    a language in a row of k = 0; written into the tables given."""
    spark = docs.sparkSession
    bounded_batches(spark)
    into = into or Scratch(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    survivors, parts = _surviving(docs, longest, often, into)
    filled, bits = _filter(survivors, parts)
    known = spark.sparkContext.broadcast(filled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _Phrases(longest)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if phrases.add(lang, text):
                    yield from told(phrases)
                    phrases.clear()
        yield from told(phrases)

    def told(phrases: _Phrases) -> Iterator[pa.RecordBatch]:
        words = list(phrases.ids)
        for lang, n, k, columns, counts, h in phrases.counted():
            ok = np.ones(len(h), bool)
            for at, bit in _probes(h, parts, bits):
                ok &= (known.value[at] & bit) > 0
            text = [b" ".join([words[i] for i in ids]).decode("utf-8", "surrogatepass") for ids in zip(*[c[ok].tolist() for c in columns])]
            counts, sizes = counts[ok].tolist(), [k] * len(text)
            if k == 1:  # once a language
                text, counts, sizes = [*text, ""], [*counts, n], [*sizes, 0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(sizes, pa.int32()), pa.array(text, pa.string()), pa.array(counts, pa.int64())], names=["lang", "k", "phrase", "n"])

    found = docs.mapInArrow(count, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return into.write(found.filter((F.col("n") >= often) | (F.col("k") == 0)), "counts")


def _key(phrase: Column | str) -> Column:
    """Language and phrase as one text; a phrase holds no line feed."""
    return F.concat("lang", F.lit("\n"), phrase)


def _looked_up(rows: DataFrame, counts: DataFrame, key: str, into: str) -> DataFrame:
    """rows with the count of their key; keys of many rows are joined map-side."""
    of = rows.groupBy(key).agg(F.count("*").alias("rows")).join(counts.select(F.col("key").alias(key), F.col("n").alias(into)), key)
    return join_split(rows, of, key)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: decimals of 38 digits, never a double."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = wide(wide(a) * wide(a)) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", wide(top), wide(wide(left) * wide(right)))


def _parts_of(w: Column) -> Column:
    """The phrases of two words or more, shorter than w, that lie in w."""
    size = F.size(w)
    return F.when(size > 2, F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, often: int = OFTEN, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to longest words, by score, a (both falling) and phrase.
    Phrases of which at least ``share`` per cent lie in one longer phrase are left out."""
    spark = docs.sparkSession
    step = Scratch(spark)
    counts = phrase_counts(docs, lang_col, text_col, longest, often, step)
    keyed = step.write(counts.filter("k > 0").withColumn("key", _key("phrase")), "keyed")
    phrases = keyed.filter("k > 1").select("lang", "key", "phrase", "k", F.col("n").alias("a"))
    w = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "key", "phrase", "a", w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "key", "phrase", "a", "cut", _key(F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ")).alias("first"),
        _key(F.array_join(F.slice("w", F.col("cut") + 1, F.size("w")), " ")).alias("rest"),
    )
    cuts = step.write(_looked_up(step.write(cuts, "cuts"), keyed, "first", "l"), "left")
    cuts = _looked_up(cuts, keyed, "rest", "r")
    best = cuts.groupBy("lang", "key", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("b"))
    longer = phrases.filter("k > 2").select("lang", "a", F.explode(_parts_of(w)).alias("p")).groupBy(_key("p").alias("key")).agg(F.max("a").alias("within"))
    best = best.join(longer, "key", "left").filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * share))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)  # top rows of each salt
    totals = counts.filter("k = 0").select("lang", "n")
    out = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = materialize(out, "collocations")
    step.clear()
    return out
