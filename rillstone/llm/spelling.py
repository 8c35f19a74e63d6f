"""Spelling variants by PartEnum signatures.

Words: the maximal runs of ``RUN`` in a text, A-Z in lower case. Some occurrences lose a letter (see ``words``), as the fixed
noise that the grouping has to find. Distinct words of at least ``LEAST`` letters and ``OFTEN`` occurrences are grouped.

Two words are near if one inserted, deleted or replaced letter makes them equal. Their multisets of letters, as binary
vectors, then differ in at most two places. PartEnum parts the places into ``FIRST`` sets, of which at least one differs in no
more than ``_rest()`` places, parts each of those into ``SECOND`` and enumerates the choices that leave so many out: two near words agree
in one signature at least. The places of one letter stay together, so a signature is the sorted word without the letters that the
choice leaves out.

A signature alone says little of short words in a small alphabet. So a bucket is split exactly: of a part of the word that
holds the one difference either its first half or what follows it agrees. That is done once for all words, and again for every
bucket of more than ``SMALL`` words whose undecided part is longer than a letter, so the words of a bucket that is compared pair by pair are
few or differ in a letter or two at a known place. Pairs are verified by their edit distance; none is missed, none is capped.

Defined cases: a null text has no words; a null id counts as the empty string in the noise; repeated rows count as often as
they come; an empty table gives an empty table; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.store import Scratch, materialize

RUN = r"[a-zÀ-ÿ]+"
LEAST, OFTEN, NOISE = 6, 5, 199
FACTOR = 5
DIFFER, FIRST, SECOND = 2, 3, 1
SMALL = 32
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *map(chr, range(0xC0, 0x100))]


def _rest(differ: int = DIFFER, first: int = FIRST) -> int:
    """In how many places the best of the first-level sets may still differ."""
    return -(-(differ + 1) // first) - 1


def left_out(differ: int = DIFFER, first: int = FIRST, second: int = SECOND) -> list[str]:
    """The letters that each signature leaves out."""
    rest = _rest(differ, first)
    if second <= rest:
        raise ValueError(f"more than {rest} second-level sets")
    at = {c: (i % first, i // first % second) for i, c in enumerate(LETTERS)}
    chosen = [(i, set(keep)) for i in range(first) for keep in combinations(range(second), second - rest)]
    return ["".join(c for c in LETTERS if not (at[c][0] == i and at[c][1] in keep)) for i, keep in chosen]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n of the words that are long and frequent enough. With h the CRC-32 of '<doc_id>:<run>', a run loses its letter at h modulo
    its length where ``NOISE`` divides h."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.translate(F.col(text_col).cast("string"), upper, lower).alias("text"))
    runs = runs.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).filter(F.length("run") >= least)
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % NOISE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _entries(vocabulary: DataFrame) -> DataFrame:
    """key, word, n, longer, a, b, c: every word under its signatures, as the shorter and as the longer word of a pair; its letters
    a to b are undecided, c of them in the shorter word."""
    out = left_out()
    sorted_ = F.array_join(F.array_sort(F.split("word", "")), "")
    signs = F.array(*[F.struct(F.lit(i).alias("i"), F.translate(sorted_, gone, "").alias("sign")) for i, gone in enumerate(out)])
    size = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(signs).alias("s"), size.alias("b")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    c = F.col("b") - F.col("longer").cast("int")
    return rows.select(F.xxhash64(c, "s.i", "s.sign").alias("key"), "word", "n", "longer", F.lit(0).alias("a"), "b", c.alias("c"))


def _split(rows: DataFrame) -> DataFrame:
    """Every row twice: under its first half, the rest undecided, and under what follows it, the first half undecided."""
    half = F.floor(F.col("c") / 2).cast("int")
    rest = F.col("c") - half
    head, tail = F.substring("word", F.col("a") + 1, half), F.substring("word", F.col("b") - rest + 1, rest)
    entry = lambda which, part, a, b, c: F.struct(F.xxhash64("key", F.lit(which), part).alias("key"), a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    both = F.array(entry(0, head, F.col("a") + half, F.col("b"), rest), entry(1, tail, F.col("a"), F.col("b") - rest, half))
    return rows.select("word", "n", "longer", F.explode(both).alias("e")).select("e.key", "word", "n", "longer", "e.a", "e.b", "e.c")


def _near(f: Column) -> Column:
    """The pairs of a bucket's words that are near, the lesser word first."""
    pair = lambda x, y: F.struct(x["word"].alias("a"), x["n"].alias("na"), y["word"].alias("b"), y["n"].alias("nb"))
    met = lambda x, y: (x["word"] < y["word"]) & ~(x["longer"] & y["longer"]) & (F.levenshtein(x["word"], y["word"], 1) == 1)
    return F.flatten(F.transform(f, lambda x: F.transform(F.filter(f, lambda y: met(x, y)), lambda y: pair(x, y))))


def near_pairs(vocabulary: DataFrame, into: Scratch, small: int = SMALL) -> DataFrame:
    """Every pair of near words once: a < b and their numbers na, nb; written into the tables given."""
    step = Scratch(vocabulary.sparkSession)
    rows, found = _split(_entries(vocabulary)), []
    while True:
        rows = step.write(rows, "entries")
        sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.max("c").alias("most"), F.min("longer").alias("all_longer")).filter("m > 1 and not all_longer")
        sizes = step.write(sizes, "sizes")
        whole = (F.col("m") <= small) | (F.col("most") <= 1)
        few = rows.join(sizes.filter(whole).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("word", "n", "longer")).alias("f"))
        found.append(step.write(few.select(F.explode(_near(F.col("f"))).alias("p")).select("p.*").distinct(), "pairs"))
        large = sizes.filter(~whole).select("key")
        if large.isEmpty():
            break
        rows = _split(rows.join(large, "key"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = into.write(pairs.distinct(), "near")
    step.clear()
    return pairs


def roots(forms: DataFrame, into: Scratch) -> DataFrame:
    """word, root: the last form that is reached from each word of forms (word, form), which never lead in a circle."""
    now = into.write(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more = into.write(now.join(step, "root", "left"), "roots")
        now = more.select("word", F.coalesce("further", "root").alias("root"))
        if more.filter("further is not null").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, small: int = SMALL) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its near word of largest n (then the least word), if that is at least
    factor times its own; its root is the last form reached, itself without one."""
    step = Scratch(docs.sparkSession)
    vocabulary = step.write(words(docs, id_col, text_col), "words")
    pairs = near_pairs(vocabulary, step, small)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("word")).alias("other"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("n"), F.col("a").alias("word")).alias("other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    fits = -F.col("best.n") >= F.col("n") * factor
    told = vocabulary.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.n")).alias("form_n")
    )
    told = step.write(told, "forms")
    reached = roots(told.filter("form is not null"), step)
    out = told.join(reached, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = materialize(out, "variants")
    step.clear()
    return out
