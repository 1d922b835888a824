"""Spelling variants: words at one edit from each other, by a dictionary of trie-node pairs.

The vocabulary's prefixes are the nodes of a forward trie and its suffixes those of a reversed one; both are numbered.
A word without its letter at position ``i`` is then a pair of integers, the node of what stands before and
that of what stands after: the *skip* pair of ``i``. A word parted before position ``i`` is its *gap* pair. Words
that meet in a skip pair differ by one replaced letter, and a skip pair that meets a gap pair is a word with one
letter more. Both are exact: equal pairs are equal strings, so nothing is left to verify.

A word and its near word meet in one pair only. Two words of one length differ at one position. A letter of
a run of equal ones can be left out anywhere in the run with the same outcome; only the run's first position meets gaps.

No pairs of words are made. All that meets in a pair differs by the letter there (a gap word is the only one of
its pair), so a group is no larger than the alphabet: 90 letters in the words taken here. Each group is
reduced to its size and its two most frequent words, of which every member takes the first that is not itself.

Forms are followed to their roots by pointer doubling. A form has ``ratio`` times the occurrences of its word, so
chains are no longer than the logarithm of the largest count and have no cycles.

Defined results: null texts have no words; a null id is the empty text before the colon of the hashed key; repeated
rows count again; an empty table has no words. Texts of any length are read whole inside their row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setwright.session import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
#: One occurrence in so many loses a letter.
SLIP = 199
#: Longer prefixes and suffixes are told apart by their SHA-256, so that a very long word's do not move as text.
LONG = 48


def vocabulary(docs: DataFrame, letters: int = 6, least: int = 5, slip: int = SLIP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the words of ``letters`` letters and ``least`` occurrences at least.

    Words are maximal runs of letters with A-Z lower-cased. Where ``slip`` divides the hash of ``<id>:<word>``, the
    occurrence is one with a letter deleted (none is, if ``slip`` is 0). Occurrences are combined before the shuffle.
    """
    run = F.explode(F.expr(f"regexp_extract_all(_t, r'{RUN}', 0)")).alias("word")
    lower = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("id"), lower.alias("_t")).select("id", run)
    if slip:
        hashed = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
        at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
        short = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        runs = hashed.select(F.when(F.col("h") % slip == 0, short).otherwise(F.col("word")).alias("word"))
    return runs.filter(F.char_length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _nodes(parts: DataFrame, part: str, number: str) -> DataFrame:
    """The distinct prefixes (or suffixes) with a number each, pinned by writing the table."""
    return staged(parts.select(part).distinct().withColumn(number, F.monotonically_increasing_id()), "trie_nodes")


def node_pairs(words: DataFrame) -> DataFrame:
    """``before, after, gap, first, word, n``: the skip and gap pairs of each word, as numbers of trie nodes.

    ``first`` marks skip pairs at the first position of a run of equal letters.
    """
    size = F.char_length("word")

    def node(part):
        return F.when(F.char_length(part) <= LONG, part).otherwise(F.concat(F.lit("#"), F.sha2(part, 256)))

    cuts = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    prefix, suffix = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 1, size)
    parted = cuts.select("word", "n", "i", node(prefix).alias("prefix"), node(suffix).alias("suffix"))
    forward, backward = _nodes(parted, "prefix", "before"), _nodes(parted, "suffix", "after")
    at = staged(parted.join(forward, "prefix").join(backward, "suffix").select("word", "n", "i", "before", "after"), "cuts")
    # The suffix after position i is the one parted at i + 1. A word has as many cuts as letters and one.
    next_after = F.lead("after").over(Window.partitionBy("word").orderBy("i"))
    letter, ahead = F.substring("word", F.col("i") + 1, F.lit(1)), F.substring("word", F.col("i"), F.lit(1))
    led = at.select("*", next_after.alias("rest"))
    gap = F.struct(F.col("after").alias("after"), F.lit(True).alias("gap"), F.lit(True).alias("first"))
    skip = F.struct(F.col("rest").alias("after"), F.lit(False).alias("gap"), ((F.col("i") == 0) | (letter != ahead)).alias("first"))
    both = led.select("word", "n", "before", F.explode(F.array(gap, skip)).alias("p"))
    return both.select("before", "p.after", "p.gap", "p.first", "word", "n").filter("after IS NOT NULL")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: how many words are one edit away, and ``(-n, word)`` of the most frequent; words without any are left out."""
    member = F.struct((-F.col("n")).alias("minus"), "word", "gap", "first")
    # As many members as there are letters, and the gap word.
    groups = node_pairs(words).groupBy("before", "after").agg(F.sort_array(F.collect_list(member)).alias("m")).filter(F.size("m") > 1)

    def seen(x, of):
        """What member ``x`` is near to: all others, but a gap word and a skip word only where that is first."""
        other = F.filter(of, lambda y: (y["word"] != x["word"]) & ((~x["gap"] & ~y["gap"]) | (x["first"] & y["first"])))
        return F.struct(x["word"].alias("word"), F.size(other).alias("near"), F.get(other, 0).alias("top"))

    each = groups.select(F.inline(F.transform("m", lambda x: seen(x, F.col("m")))))
    met = each.filter("near > 0").select("word", "near", F.struct("top.minus", "top.word").alias("best"))
    return met.groupBy("word").agg(F.sum("near").cast("bigint").alias("n_near"), F.min("best").alias("best"))


def spellings(
    docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, slip: int = SLIP, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word with most occurrences (then the first in code-point order), if it has ``ratio`` times the word's;
    ``root`` is where the forms lead.
    """
    words = staged(vocabulary(docs, letters, least, slip, key, text), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    enough = -F.col("best.minus") >= ratio * F.col("n")
    formed = staged(
        near.select(
            "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    steps = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # Each word's target takes that target's own target, so distances double.
        further = steps.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = staged(
            steps.join(further, steps["root"] == further["_at"], "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")),
            "roots",
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
