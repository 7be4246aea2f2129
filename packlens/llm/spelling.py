"""Words of a corpus with their spelling variants: words that differ by one inserted, deleted or replaced letter.

Candidates come from asymmetric chunks. A word of n letters contributes two disjoint chunks of n // 2 letters, its first and its last ones;
one edit leaves one of the two whole. The other word contributes its positional grams of that length, for a word of one letter less, as many
and one more: of all of them those that stand where a chunk can, which is at most one place off, by the difference of the lengths.
Chunks and grams meet in one equi-join on (word length, chunk, letters). What stands outside the chunk holds the edit, so one of its
own two halves is whole as well and makes the key narrower. The edit distance then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.llm.common import cut, quoted, text_or_empty

#: Letters: fixed ranges, ASCII and Latin-1.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, min_letters: int = 5, min_count: int = 3, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (runs of LETTERS, A-Z lower-cased) of min_letters or more that stand min_count times or more: word, n.

    noise: of a run whose crc32 of `<id>:<run>` it divides, the letter at crc32 % length is left out first.
    """
    run = F.explode(F.regexp_extract_all(text_or_empty(quoted(text_col)), F.lit(f"({LETTERS})")))
    held = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).alias("__id"), run.alias("run")).where(F.length("run") >= min_letters)
    held = held.withColumn("run", F.when(F.rlike("run", F.lit("[A-Z]")), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    word = F.col("run")
    if noise:
        held = held.withColumn("h", F.crc32(F.concat("__id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counted = held.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def _part(word: Column, start: Column, size: Column) -> Column:
    """`size` letters from place `start` (from 0); null where they are not all there."""
    return F.when((start >= 0) & (start + size <= F.length(word)), F.substring(word, start + 1, size))


def _key(length: Column, which: Column, chunk: Column, end: Column, rest: Column) -> Column:
    return F.when(chunk.isNotNull() & rest.isNotNull(), F.xxhash64(length, which, chunk, end, rest))


def _chunk_keys(word: Column) -> Column:
    """Keys of a word's two chunks, each with either half of what lies outside it."""
    n = F.length(word)
    q = F.floor(n / 2).cast("int")
    outer, half = n - q, F.floor((n - q) / 2).cast("int")
    first, last = _part(word, F.lit(0), q), _part(word, outer, q)
    return F.array(
        _key(n, F.lit(0), first, F.lit(0), _part(word, q, half)), _key(n, F.lit(0), first, F.lit(1), _part(word, n - half, half)),
        _key(n, F.lit(1), last, F.lit(0), _part(word, F.lit(0), half)), _key(n, F.lit(1), last, F.lit(1), _part(word, outer - half, half)))


def _gram_keys(word: Column) -> Column:
    """Keys of the grams that can be a chunk of a word one letter shorter, as long or one longer.

    What one edit leaves whole before it keeps its place; what it leaves whole behind it stands as far from its place as the lengths differ.
    """
    keys, m = [], F.length(word)
    for more in (-1, 0, 1):
        n = m + more
        q = F.floor(n / 2).cast("int")
        outer, half = m - q, F.floor((n - q) / 2).cast("int")
        first, last = _part(word, F.lit(0), q), _part(word, outer, q)
        keys += [
            _key(n, F.lit(0), first, F.lit(0), _part(word, q, half)), _key(n, F.lit(0), first, F.lit(1), _part(word, m - half, half)),
            _key(n, F.lit(1), last, F.lit(0), _part(word, F.lit(0), half)), _key(n, F.lit(1), last, F.lit(1), _part(word, outer - half, half))]
    return F.array(*keys)


def _sorted_side(df: DataFrame) -> DataFrame:
    """df as a side that is joined by sorting, never sent whole through the driver.

    Spark sizes it by the compressed file of words, and takes twelve keys a word for no more than the word: what it holds to be a few MB fills a driver.
    """
    return df.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near), both ways, of the distinct words that differ by exactly one letter edit."""
    met = lambda keys, name: words.select(F.col("word").alias(name), F.explode(keys(F.col("word"))).alias("key")).where("key is not null")
    pairs = met(_chunk_keys, "a").join(_sorted_side(met(_gram_keys, "b")), "key").where(F.levenshtein("a", "b", 1) == 1)
    links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))).alias("p")).select("p.*")


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): each round doubles how far a word looks along its forms.

    A form stands twice as often as its word, so a chain is at most as long as a count has bits.
    """
    reached = forms.select("word", F.col("form").alias("root"))
    for _ in range(6):
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(reached.join(_sorted_side(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        reached = found.select("word", "root")
        if found.where("moved").isEmpty():
            break
    return reached


def spelling_variants(docs: DataFrame, min_letters: int = 5, min_count: int = 3, times: int = 2, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word of `word_counts`: word, n, n_near, form, form_n and root.

    n_near counts the words one edit away. The form is the one of largest n among them (ties: the smallest in code-point order) if it stands `times`
    times as often or more, else null. The root is the last of the forms' forms, or the word. Edits count code points. min_letters is 4 at least: a shorter word's
    parts can be empty. Null and empty texts have no words; null ids count as empty where `noise` reads them; repeated rows count each; an empty table
    gives no rows; a text of any length is one row of its words; other columns, whatever their names, are not read.
    """
    if min_letters < 4 or times < 2:
        raise ValueError("words need four letters or more, and a form must stand twice as often or more")
    words = cut(word_counts(docs, min_letters, min_count, noise, id_col, text_col), "spelling-words")
    of = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # the largest count first, then the smallest word: counts negated, so that one minimum tells
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form"))).alias("best")
    per = cut(near_words(words).join(_sorted_side(of), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "spelling-near")
    named = words.join(_sorted_side(per), "word", "left").withColumn("ok", F.coalesce(-F.col("best.least") >= times * F.col("n"), F.lit(False)))
    judged = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("best.form")).alias("form"), F.when(F.col("ok"), -F.col("best.least")).alias("form_n")), "spelling-forms")
    roots = _rooted(judged.where("form is not null").select("word", "form"))
    return judged.join(_sorted_side(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
