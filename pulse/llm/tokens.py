"""Token counts by a linear longest-match automaton.

Words (runs without ASCII white space) are cut greedily into the longest pieces
of a vocabulary, as word-piece tokenizers do, but only the number of pieces is
wanted. The vocabulary is a trie with two roots, for pieces that start a word
and for those that go on in one. Every node has a failure link: where the text
goes on when it leaves the trie at that node, after the pieces that greedy
matching would then have popped. Their number is stored with the link, so a
word takes one step per character, and no piece is ever built or compared.

The vocabulary file is read on the driver; its pieces (tens of thousands of
short strings, whatever the corpus) are sent to the tasks. Texts are counted
where they are scanned, without a shuffle.

Defined results: a null or empty text, or one without words, has 0 words and
tokens. A word that the vocabulary cannot cover is one unknown token. Words
have no length limit. Equal rows get equal counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
# Counts of words kept by a task; the store is emptied when it is full.
CACHE = 400_000


def read_pieces(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces inside a word) of a sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    first, rest = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        p = sp.id_to_piece(i)
        if p.startswith(START):
            first.append(p[len(START):])
        elif START not in p:
            rest.append(p)
    return first, rest


class Automaton:
    """Counts the pieces of a word. An empty string among the first pieces is a
    lone start mark, a piece of its own."""

    def __init__(self, first: list[str], rest: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends = set()
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                u = root
                for c in p:
                    v = self.next[u].get(c)
                    if v is None:
                        v = self.next[u][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                    u = v
                if p:
                    ends.add(u)
                elif root == 0:
                    # A word may go on inside after its mark alone.
                    self.fail[0], self.popped[0] = 1, 1
        # Breadth first: a node's link follows from its parent's.
        queue = [0, 1]
        for u in queue:
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], n

    def count(self, word: str) -> int:
        """The number of pieces; 0 if the word cannot be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        u = n = 0
        for c in word:
            v = step[u].get(c)
            while v is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
                v = step[u].get(c)
            u = v
        while u != 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


# One automaton in a Python worker, which serves many tasks.
_BUILT: dict = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every document."""
    spark = docs.sparkSession
    common.small_batches(spark)
    pieces = read_pieces(vocabulary)
    name = (vocabulary, hash(tuple(map(tuple, pieces))))
    shared = spark.sparkContext.broadcast(pieces)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulse.llm import tokens

        if name not in tokens._BUILT:
            tokens._BUILT[name] = tokens.Automaton(*shared.value)
        count, known = tokens._BUILT[name].count, {}
        for b in batches:
            out = []
            for text in common.byte_texts(b.column(1)):
                words = text.split()
                total = unknown = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = count(w.decode())
                        if len(w) < 64:
                            if len(known) >= CACHE:
                                known.clear()
                            known[w] = n
                    if n:
                        total += n
                    else:
                        unknown += 1
                out.append((len(words), total + unknown, unknown))
            yield common.batch_of(schema, [b.column(0), *(map(list, zip(*out, strict=True)) if out else [[]] * 3)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def greedy(word: str, first: set[str], rest: set[str]) -> int:
    """The count by cutting off the longest piece again and again (for tests)."""
    i = n = 0
    while i < len(word) or n == 0:
        pieces = rest if n else first
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            if n == 0 and "" in first:
                j = 0
            else:
                return 0
        i, n = j, n + 1
    return n
