"""Spelling variants, found in tries of letter counts.

A word is described by how often each group of letters occurs in it. One inserted,
deleted or replaced letter adds at most one to a count (a surplus) and takes at most one
from another (a deficit). A trie arranges words by their successive counts; a search
goes down it depth first, on every level to the same count or, once each, to one more
and one less. The words of the leaves it reaches are compared letter by letter.

The upper levels, counts of eight coarse groups, are dealt to tasks: a word is sent to
its own counts and to those with one letter less, once for each coarse group it has.
Two words that differ by one letter meet there exactly once (see ``_roots``). The lower
levels, counts of 32 fine groups, are built and searched in the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockpipe.llm.common import dealt_in_blocks, whole_groups, written

# Fixed values of the task: what a word is, how its copies are blurred, what a form is.
RUN = "[A-Za-zÀ-ÿ]"
BLUR = 31
LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_RATIO = 10

COARSE, FINE = 8, 32  # by the last three and the last five bits of a letter's code point
BLOCK_WORDS = 1 << 16
TRIE_WORDS = 1 << 17  # words of whole groups that one trie is built of
LEAF_WORDS = 3
PATHS = 1 << 17
WIDE = 48  # longer words are compared as strings


# --- words -----------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    """Only A to Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts and how often they occur, if at least
    ``LEAST_LETTERS`` long and ``LEAST_COUNT`` times. Runs of letters are lower-cased;
    where ``BLUR`` divides the CRC-32 of ``id:run``, the run loses one letter."""
    # shorter runs cannot become words
    runs = F.regexp_extract_all(lower_ascii(docs[text_col]), F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0))
    run = F.col("run")
    named = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit(" ")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    blurred = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    words = named.select(F.when(h % BLUR == 0, blurred).otherwise(run).alias("word"))
    counts = words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


# --- the upper levels ------------------------------------------------------------------------


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words in a row, first letter of each word and the end). All
    letters are below 256, so a byte each."""
    joined = "".join(words.to_pylist()).encode("latin-1")
    lengths = np.fromiter((len(w) for w in words.to_pylist()), np.int64, len(words))
    return np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def counts_of(flat: np.ndarray, bounds: np.ndarray, groups: int) -> np.ndarray:
    """Letters of each group in each word, modulo 256."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    cells = owner * groups + (flat & (groups - 1))
    return np.bincount(cells, minlength=n * groups).reshape(n, groups).astype(np.uint8)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a word is sent to: the group's coarse counts in one
    number, and ``less``: the coarse group that the word has a letter less of there,
    0 for none, else from 1."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat, bounds = letters(batch.column(0))
        counts = counts_of(flat, bounds, COARSE)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        has = np.zeros((batch.num_rows, COARSE), dtype=bool)
        has[owner, flat & (COARSE - 1)] = True
        word, group = np.nonzero(has)
        fewer = counts[word]
        fewer[np.arange(len(word)), group] -= 1
        keys = np.concatenate((counts, fewer)).view(np.int64).ravel()
        rows = np.concatenate((np.arange(batch.num_rows), word))
        less = np.concatenate((np.zeros(batch.num_rows, np.int32), (group + 1).astype(np.int32)))
        taken = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(less), taken.column(0), taken.column(1)], names=["counts", "less", "word", "n"]
        )


# --- the lower levels ------------------------------------------------------------------------


class Trie:
    """Words by root and successive fine counts. A node of a level is a run of the
    sorted words; its children are found by (node, count) in the level's sorted keys."""

    def __init__(self, roots: np.ndarray, counts: np.ndarray):
        keyed = np.concatenate((roots.astype(">u4").view(np.uint8).reshape(-1, 4), counts), axis=1)
        self.order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
        roots, counts = roots[self.order], counts[self.order]
        new = np.concatenate(([True], roots[1:] != roots[:-1]))
        self.root_names = roots[new]
        self.starts = [np.append(np.flatnonzero(new), len(roots))]  # of nodes, by level
        self.keys = []
        for level in range(counts.shape[1]):
            node = np.cumsum(new) - 1
            new = new | np.concatenate(([True], counts[1:, level] != counts[:-1, level]))
            self.keys.append(node[new] * 256 + counts[new, level])
            self.starts.append(np.append(np.flatnonzero(new), len(roots)))

    def root(self, names: np.ndarray) -> np.ndarray:
        """Nodes of the roots with these names, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.root_names, names), len(self.root_names) - 1)
        return np.where(self.root_names[at] == names, at, -1)

    def search(
        self, query: np.ndarray, node: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, counts: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) for all words in leaves that are reached from the given roots
        within the budgets. Paths are followed depth first, ``PATHS`` at a time."""
        stack = [(0, query, node, surplus, deficit)]
        while stack:
            level, query, node, surplus, deficit = stack.pop()
            if len(query) > PATHS:
                half = len(query) // 2
                stack.append((level, query[half:], node[half:], surplus[half:], deficit[half:]))
                stack.append((level, query[:half], node[:half], surplus[:half], deficit[:half]))
                continue
            starts = self.starts[level]
            size = starts[node + 1] - starts[node]
            leaf = size <= (LEAF_WORDS if level < len(self.keys) else len(self.order))
            if leaf.any():
                at, many = starts[node[leaf]], size[leaf]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield np.repeat(query[leaf], many), self.order[np.repeat(at, many) + step]
            on = ~leaf
            if not on.any():
                continue
            query, node, surplus, deficit = query[on], node[on], surplus[on], deficit[on]
            own, keys = counts[query, level], self.keys[level]
            follow = []
            for change, left in ((0, None), (1, surplus), (-1, deficit)):
                way = np.arange(len(query)) if left is None else np.flatnonzero(left)
                wanted = node[way] * 256 + (own[way] + np.uint8(change % 256))
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[at] == wanted
                way, at = way[hit], at[hit]
                follow.append((query[way], at, surplus[way] & (change != 1), deficit[way] & (change != -1)))
            stack.append((level + 1, *(np.concatenate(parts) for parts in zip(*follow))))


def one_edit_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[head + 1 :] == b[head + 1 :]
    a, b = sorted((a, b), key=len)
    return a[head:] == b[head + 1 :]


class Verifier:
    """Compares many pairs of words at once."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray):
        self.flat, self.bounds = flat, bounds
        self.lengths = np.diff(bounds)
        self.rows = np.zeros((len(self.lengths), WIDE + 1), dtype=np.uint8)  # ends in a zero
        short = np.minimum(self.lengths, WIDE)
        owner = np.repeat(np.arange(len(short)), short)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(short) - short, short)
        self.rows[owner, place] = flat[bounds[:-1][owner] + place]

    def word(self, i: int) -> str:
        return self.flat[self.bounds[i] : self.bounds[i + 1]].tobytes().decode("latin-1")

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.lengths[a] > self.lengths[b]
        short, long = np.where(swap, b, a), np.where(swap, a, b)
        extra = self.lengths[long] - self.lengths[short]
        x, y = self.rows[short], self.rows[long]
        same = x == y
        head = np.where(same.all(axis=1), WIDE + 1, same.argmin(axis=1))
        shifted = x[:, :-1] == y[:, 1:]  # the longer word without the letter at ``head``
        last = np.where(shifted.all(axis=1), -1, WIDE - 1 - shifted[:, ::-1].argmin(axis=1))
        found = np.where(extra == 0, (~same).sum(axis=1) == 1, (extra == 1) & (last < head))
        for i in np.flatnonzero((self.lengths[long] > WIDE) & (extra <= 1)):
            found[i] = one_edit_apart(self.word(a[i]), self.word(b[i]))
        return found


def _roots(less: np.ndarray) -> np.ndarray:
    """[query's less, member's less]: whether the two are compared in a group. Words of
    equal coarse counts t are only where both have nothing less, at t. If one has a
    letter of group g more, at the other's t, where it has one less of g. If letters of
    groups g and h are exchanged, where one has one less of g, the other of h. So a pair
    meets in one group and, g and h being in order, from one side, but for equal
    counts, where both sides come up."""
    return (less[:, None] == 0) | ((less[None, :] > less[:, None]) & (less[:, None] > 0))


def near_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with near words among the groups of a table, each pair once."""
    column = table.column("word").combine_chunks()
    flat, bounds = letters(column)
    counts, verify = counts_of(flat, bounds, FINE), Verifier(flat, bounds)
    less = table.column("less").to_numpy().astype(np.int64)
    own, i, j = (table.column(c).to_numpy().astype(np.int64) for c in ("__own", "__i", "__j"))
    key = table.column("counts").to_numpy()
    cell = np.cumsum(
        np.concatenate(([0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    )
    apart = i != j
    side = (apart & (own == j)).astype(np.int64)
    width = COARSE + 1
    trie = Trie((cell * 2 + side) * width + less, counts)
    meet = _roots(np.arange(width))
    query, other = np.nonzero(meet[less])  # rows by what members have less
    target = np.where(apart, 1 - side, side)
    node = trie.root((cell[query] * 2 + target[query]) * width + other)
    query, other, node = query[node >= 0], other[node >= 0], node[node >= 0]
    # a longer member has a surplus only; else there may be both
    both = (less[query] > 0) | (other == 0)
    for a, b in trie.search(query, node, np.ones(len(query), dtype=bool), both, counts):
        once = (less[a] != 0) | (less[b] != 0) | (a < b)
        a, b = a[once], b[once]
        near = verify.near(a, b)
        yield a[near], b[near]


def _finder(trie_words: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["counts", "__i", "__j"], trie_words):
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            for a, b in near_pairs(table):
                rows, others = pa.array(np.concatenate((a, b))), pa.array(np.concatenate((b, a)))
                yield pa.RecordBatch.from_arrays(
                    [word.take(rows), word.take(others), n.take(others)], names=["word", "near", "near_n"]
                )

    return find


# --- the operator ----------------------------------------------------------------------------


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, near, near_n): every two words of ``words`` (distinct word, n) that
    differ by one letter, from both sides. Words consist of letters below U+0100.

    A word is sent to as many groups as it has coarse letter groups, and one more. A
    group of more than ``block_words`` is cut into blocks that meet pairwise; a task
    holds at most two blocks, or whole groups of about ``trie_words``."""
    placed = written(words.mapInArrow(_placed, "counts long, less int, word string, n long"), "placed-words")
    cells = dealt_in_blocks(placed, ["counts"], F.xxhash64("word", "less"), block_words)
    keys = ["counts", "__i", "__j"]
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)
    return cells.mapInArrow(_finder(trie_words), "word string, near string, near_n long")


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_words: int = BLOCK_WORDS,
    trie_words: int = TRIE_WORDS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``word_counts``: its near
    words' number; its form, the near word that occurs most (of equal ones the first
    in code-point order) if that is at least ``FORM_RATIO`` times as often; and the
    root that forms lead to, the word itself if it has none.

    Counts are formed before any shuffle; from there on the work is on distinct words.
    Chains of forms are at most as long as the largest count has digits, so roots take
    few joins, by doubling.

    Null and empty texts have no words; a null id counts as one blank in the checksum;
    repeated rows count as often as they occur; other columns are ignored. An empty
    table gives an empty result.
    """
    words = written(word_counts(docs, id_col, text_col), "word-counts")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), "near")).alias("best")
    near = near_words(words, block_words, trie_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = words.join(near, "word", "left").withColumn("most", -F.col("best.neg"))
    is_form = F.col("most") >= FORM_RATIO * F.col("n")
    formed = written(
        formed.select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("most")).alias("form_n"),
        ),
        "word-forms",
    )
    most = words.agg(F.max("n")).first()[0] or LEAST_COUNT
    steps = int(math.log(most / LEAST_COUNT, FORM_RATIO)) + 1
    leads = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        leads = written(
            leads.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "word-roots"
        )
    return formed.join(leads, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
