"""Records of evaluation splits that occur, exactly or almost, in the training split (problem 2)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, permutations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.words import LINKING, fold, singular, slips
from termloom.runtime import cut, hot_keys, salted_join

#: Texts that name nothing, after normalisation.
NAMELESS = frozenset("other|others|n a|na|none|null|nil|nan|tbd|tba|tbc|unknown|misc|miscellaneous|various|general|unspecified|not applicable|not available|to be determined|to be confirmed|see note|see notes|blank|empty|x|xx|xxx|untitled|no name".split("|"))
#: Slips of the pen that two nearly equal texts may have in all.
SLIPS = 2
#: A bucket with more pairs than this is split by the spelling of the words left out.
BUCKET_PAIRS = 2_500

#: Texts of more words take part by hashes of word buckets instead; both sides of the border do both, as a pair's lengths differ by one at most.
MANY_WORDS, BUCKETS = 24, 5

_WORD = re.compile(r"[^\W\d_]+|\d+")


def canonical_words(text: str | None) -> list[str]:
    """The meaningful words of a text in order: without case, accents, punctuation, linking words, in the singular; numbers apart.
    Empty for a text that names nothing."""
    if not text:
        return []
    words = _WORD.findall(fold(text))
    if not words or " ".join(words) in NAMELESS:
        return []
    kept = [singular(w) for w in words if w not in LINKING]
    return kept if kept and " ".join(kept) not in NAMELESS else []


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts)) - (1 << 63)


def signatures(words: list[str]) -> Iterator[tuple[int, int]]:
    """(hash of what is left, code of what is left out, as left_out reads it). Two texts with at most two slips agree in one of them: one
    word left out (both slips in it), two words (one slip in each), or two neighbours against one word (a blank more or less). Numbers stay. In long
    texts the words fall into five buckets by hash: at most four of them can differ between two texts that are nearly the same."""
    ordered = sorted(words)
    if len(words) > MANY_WORDS - 2:
        parts: list[list[str]] = [[] for _ in range(BUCKETS)]
        for w in ordered:
            parts[_hash(w) % BUCKETS].append(w)
        for i, part in enumerate(parts):
            yield _hash("b", str(i), *part), 0
        if len(words) > MANY_WORDS:
            return
    free = [i for i, w in enumerate(ordered) if not w.isdigit()]
    rest = lambda out: [w for i, w in enumerate(ordered) if i not in out]
    yield _hash("1", *ordered), 0
    for i in free:
        yield _hash("1", *rest((i,))), i + 1
    for i, j in combinations(free, 2):
        yield _hash("2", *rest((i, j))), (i + 1) * 64 + j + 1
    for k, (a, b) in enumerate(zip(words, words[1:])):
        if not a.isdigit() and not b.isdigit():
            left = list(ordered)
            left.remove(a)
            left.remove(b)
            yield _hash("1", *left), -(k + 1)


def left_out(words: list[str], code: int) -> list[str]:
    """The words that a signature leaves out: none, one or two of the sorted words, or two neighbours as one word."""
    if code < 0:
        return ["".join(words[-code - 1 : -code + 1])]
    ordered = sorted(words)
    return [ordered[i - 1] for i in divmod(code, 64) if i]


def _shorter(word: str, times: int) -> set[str]:
    if len(word) > 40:
        return {""}  # such words don't split a bucket
    out = level = {word}
    for _ in range(times):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _spelling_keys(words: pd.Series, code: pd.Series) -> pd.Series:
    """Keys that any two spellings within the slips share: the words left out with up to two letters less, or one less in each of two."""
    out = []
    for text, c in zip(words, code):
        left = left_out(text.split(" "), c) or [""]
        if len(left) == 1:
            out.append([_hash("s", w) for w in _shorter(left[0], SLIPS)])
        else:
            out.append(list({_hash("d", *sorted((x, y))) for x in _shorter(left[0], 1) for y in _shorter(left[1], 1)}))
    return pd.Series(out)


def nearly_same(a: list[str], b: list[str]) -> bool:
    """Whether two lists of canonical words differ by at most two slips in all, in any order. Numbers must be the same."""
    left, right = Counter(a), Counter(b)
    x, y = list((left - right).elements()), list((right - left).elements())
    if not x and not y:
        return True
    if any(w.isdigit() for w in x + y) or not x or not y or len(x) > 2 or len(y) > 2:
        return False
    if len(x) == len(y):
        return any(sum(slips(p, q) for p, q in zip(x, order)) <= SLIPS for order in permutations(y)) or (
            len(x) == 2 and any(slips("".join(p), "".join(q)) <= SLIPS for p in permutations(x) for q in permutations(y))
        )
    return any(slips("".join(p), "".join(q)) <= SLIPS for p in permutations(x) for q in permutations(y))


@F.pandas_udf(T.BooleanType())
def _nearly(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([nearly_same(p.split(" "), q.split(" ")) for p, q in zip(a, b)], dtype=bool)


def members(rows: DataFrame, key: str, text: str, split: str, train: list[str], evaluation: list[str]) -> DataFrame:
    """Distinct key, train (whether the row is of a training split), id and words of the class of equal texts. Rows with a null key, without one of the
    splits, or whose text names nothing are left out."""
    sides = rows.filter(F.col(key).isNotNull() & F.col(split).isin(train + evaluation)).select(F.col(key).alias("key"), F.col(split).isin(train).alias("train"), F.col(text).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [canonical_words(t) for t in b.column(2).to_pylist()]
            joined = [" ".join(w) if w else None for w in words]
            ids = [_hash(*sorted(w)) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(joined, pa.string())], names=["key", "train", "id", "words"])

    kind = rows.schema[key].dataType.simpleString()
    return sides.mapInArrow(run, f"key {kind}, train boolean, id long, words string").filter("id is not null")


def near_classes(people: DataFrame) -> DataFrame:
    """Pairs (tid, eid) of different classes of equal texts, the first with a training member, the second with one for evaluation,
    whose texts are nearly the same.

    Every class sends one row per signature, once for all its copies. Signatures that only one side holds end there; in those with many pairs the rows
    meet by the spelling of the words left out instead, which loses no pair within the slips. What meets is compared exactly."""
    classes = cut(people.groupBy("id").agg(F.min("words").alias("words"), F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for ident, words, t, e in zip(*(c.to_pylist() for c in b.columns)):
                for sig, code in signatures(words.split(" ")):
                    for c, v in zip(cols, (sig, ident, t, e, code)):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int16())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sig", "id", "t", "e", "code"])

    rows = classes.select("id", "words", "t", "e").mapInArrow(run, "sig long, id long, t boolean, e boolean, code short")
    by_sig = rows.repartition("sig")
    # the count of codes keeps their column, so that the aggregate and the join below read one and the same shuffle
    load = by_sig.groupBy("sig").agg(F.count_if("t").alias("nt"), F.count_if("e").alias("ne"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("code").alias("_n")).filter("_n > 0")
    load = load.filter("nt > 0 and ne > 0 and lo <> hi").select("sig", (F.col("nt") * F.col("ne") > BUCKET_PAIRS).alias("hot"))
    held = cut(by_sig.join(load, "sig").select("sig", "id", "t", "e", "code", "hot"))
    cool = held.filter("not hot").select("sig", F.lit(0).cast("long").alias("spelling"), "id", "t", "e")
    hot = held.filter("hot").join(classes.select("id", "words"), "id").select("sig", F.explode(_spelling_keys("words", "code")).alias("spelling"), "id", "t", "e")
    every = cool.unionByName(hot)
    left = every.filter("t").select("sig", "spelling", F.col("id").alias("tid"))
    right = every.filter("e").select("sig", "spelling", F.col("id").alias("eid"))
    pairs = left.join(right, ["sig", "spelling"]).filter("tid <> eid").select("tid", "eid").distinct()
    named = pairs.join(classes.select(F.col("id").alias("tid"), F.col("words").alias("tw")), "tid").join(classes.select(F.col("id").alias("eid"), F.col("words").alias("ew")), "eid")
    return named.filter(_nearly("tw", "ew")).select("tid", "eid")


TRAIN, EVALUATION = ["tune"], ["frozen", "firm2"]


def _scored(gold: DataFrame) -> DataFrame:
    return gold.filter(~F.coalesce("blank", F.lit(False)))


def found_pairs(gold: DataFrame) -> DataFrame:
    """item_a, item_b: pairs of a training and an evaluation item with the same or nearly the same leaf, the smaller first; an
    item in both is the pair of itself. Blank rows are left out."""
    people = cut(members(_scored(gold), "item_id", "leaf", "slice", TRAIN, EVALUATION))
    train, evaluation = people.filter("train").select("id", F.col("key").alias("x")).distinct(), people.filter("not train").select("id", F.col("key").alias("y")).distinct()
    sizes = train.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    same = salted_join(train, evaluation, "id", hot_keys(sizes, "id", "n"), F.col("x")).select("x", "y")
    near = near_classes(people)
    almost = near.join(train.withColumnRenamed("id", "tid"), "tid").join(evaluation.withColumnRenamed("id", "eid"), "eid").select("x", "y")
    itself = people.groupBy("key").agg(F.bool_or("train").alias("t"), F.bool_or(~F.col("train")).alias("e")).filter("t and e").select(F.col("key").alias("x"), F.col("key").alias("y"))
    every = same.unionByName(almost).unionByName(itself)
    return every.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).distinct()


def report(gold: DataFrame) -> DataFrame:
    """slice, workbook, items, same, nearly: how many evaluation items there are, how many of them have an equal leaf in the
    training split or lie in it themselves, and how many others have a nearly equal one. A null workbook is a group of its own."""
    rows = _scored(gold)
    people = cut(members(rows, "item_id", "leaf", "slice", TRAIN, EVALUATION))
    classes = people.groupBy("id").agg(F.bool_or("train").alias("in_train"))
    near = near_classes(people).select(F.col("eid").alias("id"), F.lit(True).alias("is_near")).distinct()
    both = people.groupBy("key").agg(F.bool_or("train").alias("itself"))
    marks = people.filter("not train").join(classes, "id").join(near, "id", "left").join(both, "key")
    marks = marks.groupBy("key").agg(F.bool_or(F.col("in_train") | F.col("itself")).alias("same"), F.bool_or(F.coalesce("is_near", F.lit(False))).alias("near"))
    items = rows.filter(F.col("slice").isin(EVALUATION) & F.col("item_id").isNotNull()).select("slice", "workbook", F.col("item_id").alias("key")).distinct()
    joined = items.join(marks, "key", "left").withColumn("same", F.coalesce("same", F.lit(False))).withColumn("near", F.coalesce("near", F.lit(False)))
    return joined.groupBy("slice", "workbook").agg(F.count(F.lit(1)).alias("items"), F.count_if("same").alias("same"), F.count_if(F.col("near") & ~F.col("same")).alias("nearly"))
