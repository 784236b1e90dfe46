"""Text augmentation as a whole-table Spark job.

Each copy of a row gets its text split into words, then (1) words that have
synonyms are replaced with probability p, (2) two words are swapped in texts
of more than 5 words with probability p, (3) one word of more than 2 letters
gets one letter replaced with probability p. All random choices are seeded
hashes of (seed, row id, copy, position, purpose) - see pulse.functions.draws
- so output is repeatable and independent of partitioning and retries.
Everything is array expressions (transform, element_at, overlay) on the
executors; copies come from explode(sequence(1, k)), a narrow operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.draws import pick, uniform
from pulse.functions.text import words as split_words

# The producer's synonym map and probabilities.
SYNONYMS = {
    "great": ["fantastic", "awesome", "superb"],
    "good": ["nice", "positive", "fine"],
    "bad": ["terrible", "horrible", "awful"],
    "happy": ["joyful", "delighted", "glad"],
    "sad": ["unhappy", "gloomy", "depressed"],
    "love": ["adore", "cherish", "like"],
    "hate": ["detest", "dislike", "loathe"],
}
P_SYNONYM = 0.3
P_SWAP = 0.1
SWAP_MIN_WORDS = 6   # more than 5 words
P_TYPO = 0.05
TYPO_MIN_LEN = 3     # more than 2 letters
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def synonym_map(mapping: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def replace_synonyms(words: Column, mapping: dict, p: float, seed: int, row: Column, copy) -> Column:
    """Each word that is a key of ``mapping`` is replaced, with probability p,
    by one of its synonyms chosen uniformly."""
    m = synonym_map(mapping)

    def step(w, i):
        syns = F.try_element_at(m, w)
        hit = syns.isNotNull() & (uniform(seed, row, copy, i, "syn") < F.lit(p))
        choice = F.element_at(syns, pick(F.size(syns), seed, row, copy, i, "syn_pick") + 1)
        return F.when(hit, choice).otherwise(w)
    return F.transform(words, step)


def _replace_at(words: Column, k: Column, value: Column) -> Column:
    """words with position k (0-based) set to value: slices and concat, so
    row-level draws are evaluated once per row, not once per element."""
    return F.concat(F.slice(words, 1, k), F.array(value), F.slice(words, k + 2, F.size(words)))


def swap_words(words: Column, p: float, seed: int, row: Column, copy) -> Column:
    """With probability p, and only in arrays of more than 5 words, swap two
    different positions i and j (j drawn among the n-1 others)."""
    n = F.size(words)
    do = (n >= SWAP_MIN_WORDS) & (uniform(seed, row, copy, "swap") < F.lit(p))
    i = pick(n, seed, row, copy, "swap_i")
    j0 = pick(n - 1, seed, row, copy, "swap_j")
    j = F.when(j0 >= i, j0 + 1).otherwise(j0)
    lo, hi = F.least(i, j), F.greatest(i, j)
    swapped = F.concat(F.slice(words, 1, lo), F.array(F.try_element_at(words, hi + 1)),
                       F.slice(words, lo + 2, hi - lo - 1), F.array(F.try_element_at(words, lo + 1)),
                       F.slice(words, hi + 2, n))
    return F.when(do, swapped).otherwise(words)


def typo(words: Column, p: float, seed: int, row: Column, copy) -> Column:
    """With probability p pick one word; if it has more than 2 letters,
    replace the letter at a drawn position by a drawn letter a-z."""
    n = F.size(words)
    idx = pick(n, seed, row, copy, "typo_i")
    w = F.try_element_at(words, idx + 1)
    pos = pick(F.length(w), seed, row, copy, "typo_pos")
    letter = F.substr(F.lit(LETTERS), pick(F.lit(len(LETTERS)), seed, row, copy, "typo_ch") + 1, F.lit(1))
    changed = F.overlay(w, letter, pos + 1, F.lit(1))
    do = (n > 0) & (uniform(seed, row, copy, "typo") < F.lit(p))
    return F.when(do & (F.length(w) >= TYPO_MIN_LEN), _replace_at(words, idx, changed)).otherwise(words)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: a let-binding
    through a one-element transform. Swap and typo read their input array
    several times; bound like this, an optimizer rewrite that inlines the
    chain (a pushed-down filter on the output) copies it once, not once per
    read (which would multiply the chain 35-fold)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def augment_words(df: DataFrame, text: str, id_col: str, seed: int, copy="copy",
                  mapping: dict | None = None, p_syn: float = P_SYNONYM, p_swap: float = P_SWAP,
                  p_typo: float = P_TYPO, steps: tuple[str, ...] = ("syn", "swap", "typo"),
                  out: str = "augmented") -> DataFrame:
    """Add ``out``: the augmented text (words re-joined by one space). NULL
    text stays NULL. One expression per row; unused, it is pruned away."""
    mapping = SYNONYMS if mapping is None else mapping
    row = F.col(id_col)
    cp = F.col(copy) if isinstance(copy, str) else F.lit(copy)
    w = split_words(text)
    if "syn" in steps:
        w = replace_synonyms(w, mapping, p_syn, seed, row, cp)
    if "swap" in steps:
        w = let(w, lambda x: swap_words(x, p_swap, seed, row, cp))
    if "typo" in steps:
        w = let(w, lambda x: typo(x, p_typo, seed, row, cp))
    return df.withColumn(out, F.array_join(w, " "))


def augment(df: DataFrame, copies: int, seed: int, base_time: float, id_col: str = "tweet_id",
            text: str = "tweet_content", mapping: dict | None = None) -> DataFrame:
    """k augmented copies of every row, as messages of contract A: a new id
    (hash of seed, row and copy, in place of a random UUID), the original id,
    entity, sentiment, augmented text and a fixed event time. Ids and draws
    come from the row's content (id, entity, class, text), so rows that share
    an id stay apart; only wholly equal rows get equal copies."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0"))
                                   for c in (id_col, "entity", "sentiment", text)]))
    expanded = df.select("*", row.alias("_row"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    aug = augment_words(expanded, text, "_row", seed, "copy", mapping)
    new_id = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_row"), F.col("copy").cast("string")))
    return aug.select(new_id.alias("tweet_id"),
                      F.col(id_col).cast("string").alias("original_tweet_id"),
                      F.col("copy"), F.col("entity"), F.col("sentiment"),
                      F.col("augmented").alias("tweet_content"),
                      F.lit(float(base_time)).alias("timestamp"))
