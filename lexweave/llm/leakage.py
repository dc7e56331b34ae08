"""Problem 9: passages of evaluation texts in a training corpus.

Pigeonhole edit matching on words: every passage of `passage` consecutive words of an item (12) may stand in a document with at most
`budget` edits (1: a word put in, left out or exchanged). It is split into budget + 1 pieces, one of which must then stand there
unchanged. The pieces of all passages of a block of items (all runs of six words) form one Aho-Corasick automaton, against which each
document is read once. Hits in a row on one diagonal are one common run, and all passages that hold one of the hits
are verified with Myers' bit-parallel distance (on words; a run of a passage's length is settled by its first passage). A pair is reported if one of them keeps within the budget;
with 0 edits the item and the document have 12 consecutive words in common.

Items are the stated query set: they come to the driver in blocks of bounded size, and every block is held against all
documents, at one scan of them and about 300 MB of broadcast automaton input and executor memory for each block of 2 million words.
Cases: null and empty texts match nothing, items below `passage` words have no passage; rows with a null id are left out; repeated
rows give one result; ids may be of any type.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexweave.functions.keys import reject_missing

PASSAGE, BUDGET = 12, 1
BLOCK_WORDS = 2_000_000  # words of items held at once


def normal_words(text: str | None) -> list[str]:
    """Runs of a-z0-9 of the lower-cased text without soft hyphens and zero-width spaces."""
    if not text:
        return []
    table = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
    plain = text.lower().replace("\xad", "").replace("​", "").encode("ascii", "replace")
    return plain.translate(table).decode("ascii").split()


def myers(pattern: list, text: list) -> int:
    """Least number of edits between the whole pattern and any stretch of the text."""
    m = len(pattern)
    if not m:
        return 0
    at: dict = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for x in text:
        eq = at.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # the stretch may start anywhere, so nothing is carried in
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


def _blocks(items: DataFrame, id_col: str, text: str, limit: int):
    block, size = [], 0
    for i, t in items.select(id_col, text).distinct().orderBy(id_col).toLocalIterator():
        w = normal_words(t)
        if i is None or not w:
            continue
        block.append((i, w))
        size += len(w)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    passage: int = PASSAGE,
    budget: int = BUDGET,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(item_id, doc_id, run_words, edits): pairs with a passage of the item in the document, the longest run of words in common
    and the least edits of a passage (0 exactly where run_words reaches the passage's length)."""
    reject_missing(docs, doc_id, text)
    reject_missing(items, item_id, text)
    if not 0 <= budget < passage:
        raise ValueError("a passage must have more words than edits")
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    kind = T.StructType([T.StructField("item_id", items.schema[item_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType)]).add("run_words", T.IntegerType()).add("edits", T.IntegerType())
    out = None
    for block in _blocks(items, item_id, text, block_words):
        part = source.mapInArrow(_scanner(sc.broadcast(block), to_arrow_type(kind["item_id"].dataType), passage, budget), kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], kind)
    return out.groupBy("item_id", "doc_id").agg(F.max("run_words").alias("run_words"), F.min("edits").alias("edits"))


def _scanner(sent, id_type, passage: int, budget: int):
    piece = passage // (budget + 1)

    def run(batches):
        import ahocorasick

        block = sent.value
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(block):
            if len(w) >= passage:
                for i in range(len(w) - piece + 1):
                    where.setdefault(" " + " ".join(w[i : i + piece]) + " ", []).append((n, i))
        machine = ahocorasick.Automaton()
        for k, v in where.items():
            machine.add_word(k, (len(k), v))
        machine.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = normal_words(t)
                if len(w) < piece or not where:
                    continue
                hits = list(machine.iter(" " + " ".join(w) + " "))
                if hits:
                    rows += [(block[n][0], d, *x) for n, x in _judge(w, hits, block, piece, passage, budget)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (id_type, batch.column(0).type, pa.int32(), pa.int32()))],
                ["item_id", "doc_id", "run_words", "edits"],
            )

    return run


def _judge(w, hits, block, piece, passage, budget):
    """(item, (longest run, least edits)) of the items that keep within the budget in the document w."""
    starts = list(accumulate(map(len, w), lambda at, n: at + n + 1, initial=0))
    diagonals: dict[tuple[int, int], list[int]] = defaultdict(list)
    for end, (length, places) in hits:
        j = bisect.bisect_left(starts, end + 1 - length)  # index of the hit's first word
        for n, i in places:
            diagonals[n, j - i].append(i)
    found: dict[int, tuple[int, int]] = {}
    near = budget + 1
    for (n, shift), at in diagonals.items():
        item = block[n][1]
        longest, best = found.get(n, (0, budget + 1))
        first = last = at[0]
        for i in [*at[1:], None]:  # rising, for the document was read in order
            if i is not None and i == last + 1:
                last = i
                continue
            end = last + piece
            longest = max(longest, end - first)
            # a passage within the budget that reaches beyond the run on one side has, cut to the run's other end, no more edits;
            # and of the budget + 1 words next to the run, one must have its like near by
            if best:
                right, left = item[end : end + near], item[max(0, first - near) : first]
                at_right = min(first, len(item) - passage)
                at_left = max(0, end - passage)
                after = w[end + shift : end + shift + near + budget]
                before = w[max(0, first + shift - near - budget) : max(0, first + shift)]
                for s, words, like in ((at_right, right, after), (at_left, left, before)):
                    if best and (end - first > passage - near or not set(words).isdisjoint(like) or len(words) < near):
                        around = w[max(0, s + shift - budget) : s + shift + passage + budget]
                        if len(set(item[s : s + passage]).difference(around)) <= budget:
                            best = min(best, myers(item[s : s + passage], around))
            first = last = i
        found[n] = longest, best
    return ((n, x) for n, x in found.items() if x[1] <= budget)
