"""Interpolated modified Kneser-Ney n-gram model, counted in Spark.

Counting.  First the words: each gets a number, small for frequent words, in a
sorted hash array in the shared folder.  From then on an n-gram is a row of
numbers.  A task counts the n-grams of its blocks and sends each shard its rows,
sorted and compressed.  A shard writes a sorted hash array and sends on what the
next lower order needs; so each order is one shuffle of pre-aggregated rows,
whose files are removed when the order is done, and the model never passes
through the driver, which gets the few sums that the discounts are made of.

Shards.  An n-gram goes to the shard of its context (all its words but the
last), so that the sums over a context are made where its n-grams meet.  A
context of frequent words only may have a third of all n-grams: such n-grams are
spread by all their words, and the sums of their context, one row from each
shard, meet in the next shuffle.

Scoring.  Workers map the sorted arrays into memory and look up all n-grams of
a block at once by binary search; documents are not shuffled.

Counts of the highest order are those of the text; lower orders count distinct
words before the n-gram (n-grams that open a document keep their own count).
Each order has discounts for counts of 1, 2, and 3 or more (Chen and Goodman,
1998), estimated from counts of counts; the lowest interpolates with the
uniform distribution over the vocabulary and one unknown word.

Defined results: a null or empty text is one end token.  Rows repeated count as
often as they are there.  Without training text every base and model
probability is that of the uniform distribution over the unknown word, 1.  A
null id is in the training part and scored like others.  Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import forget, lookup, shard_of, sum_by, write_table
from .shared import fresh_dir, landed, remove_dir, small_batches
from .vocabulary import KIND, Gathered, Vocabulary, distinct_rows, number_words, receive, send, sent_rows, table_name
from .words import UNSPACED, blocks, find_words, mix, row_hashes, run_hashes, text_bytes

#: Highest order; bytes of text in a block; tokens counted in a shard, about; shards at least.
ORDER, BLOCK_BYTES, SHARD_TOKENS, LEAST_SHARDS = 3, 6 << 20, 4_000_000, 48
#: Hashes of the marks before and after a document; no word has them but by chance of 2**-64.
OPEN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def stream(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with order - 1 opening marks and one end each; places of the tokens; tokens per text."""
    words = find_words(*text_bytes(texts), UNSPACED, fold=True)
    extra = np.arange(len(words.counts)) * order
    out = np.full(len(words.starts) + order * len(words.counts), OPEN)
    out[np.arange(len(words.starts)) + np.repeat(extra, words.counts) + order - 1] = words.hashes()
    out[words.first[1:] + extra + order - 1] = END
    real = np.ones(len(out), bool)
    for i in range(order - 1):
        real[words.first[:-1] + extra + i] = False
    return out, np.flatnonzero(real), words.counts + 1


@dataclass
class Model:
    """Where the arrays are, and the sums over them.  counts[k][j]: n-grams of order k with count j (4: n/a above)."""

    words: Vocabulary
    order: int
    counts: dict[int, list[int]]
    kinds: int  # sum of the counts of the lowest order
    tokens: int
    vocabulary: int

    def discounts(self, k: int) -> np.ndarray:
        """For counts 0, 1, 2, 3 and more."""
        n1, n2, n3, n4 = self.counts.get(k, [0] * 4)
        if not n1 or not n2:
            return np.array([0.0, 0.5, 0.75, 0.75])
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
        return np.array([0.0, *(min(max(d, 0.05), j + 0.95) for j, d in enumerate(raw))])

    def delete(self) -> None:
        forget()
        remove_dir(self.words.uri)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text (log10)."""
        uri, shards = self.words.uri, self.words.shards
        hashes, at, count = stream(texts, self.order)
        first = np.cumsum(count) - count
        kinds, back = np.unique(hashes, return_inverse=True)
        known, seen, number = self.words.of(kinds)
        opens = kinds == OPEN
        number[opens] = 0
        name = np.where(known | opens, mix(number), kinds)  # an unknown word has its own hash, which no table has
        rare = np.where(known | opens, number, np.uint64(2**63))
        base = np.log10((seen + 1.0) / (self.tokens + self.vocabulary + 1.0))
        own = row_hashes([name])
        c = lookup(uri, "grams1", shard_of(own, shards), own, 1)[1][:, 0].astype(np.int64)
        d = self.discounts(1)
        p = np.full(len(kinds), 1.0 / (self.vocabulary + 1.0))
        if self.kinds:
            n = self.counts[1]
            rest = d[1] * n[0] + d[2] * n[1] + d[3] * (self.vocabulary - n[0] - n[1])
            p = np.maximum(c - d[np.minimum(c, 3)], 0) / self.kinds + rest / self.kinds * p
        back = back.reshape(-1)
        words, often = name[back], self.words.spread([rare])[back]
        p, back = p[back[at]], back[at]
        for k in range(2, self.order + 1):
            from_ = at - k + 1
            context, full = run_hashes(words, k - 1)[from_], run_hashes(words, k)[from_]
            spread = np.ones(len(at), bool)
            for i in range(k - 1):
                spread &= often[from_ + i]
            sums = np.zeros((len(at), 4), np.uint64)
            for table, some in ((f"context{k}", ~spread), (f"spread{k}", spread)):
                sums[some] = lookup(uri, table, shard_of(context[some], shards), context[some], 4)[1]
            c = lookup(uri, f"grams{k}", shard_of(np.where(spread, full, context), shards), full, 1)[1][:, 0].astype(np.int64)
            d = self.discounts(k)
            sums = sums.astype(float)
            total = np.maximum(sums[:, 0], 1)
            p = np.where(sums[:, 0] > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / total + (sums[:, 1:] @ d[1:]) / total * p, p)
        total = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        return count, total((seen > 0)[back].astype(np.int64)), total(base[back]), total(np.log10(p))


def _counted(words: np.ndarray, at: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams that end at the places `at`, and how often each does."""
    kinds, back = np.unique(words, return_inverse=True)
    back = back.reshape(-1).astype(np.uint64)
    columns, counts = distinct_rows([back[at - order + 1 + i] for i in range(order)], np.ones(len(at), np.uint64))
    return [kinds[c.astype(np.int64)] for c in columns], counts


def fit(texts: DataFrame, text_col: str = "text", order: int = ORDER, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count all rows of texts; the arrays go to the shared folder and are removed when the driver ends."""
    spark = texts.sparkSession
    small_batches(spark)
    uri = fresh_dir(spark, "ngrams")
    rows = texts.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // (6 * shard_tokens)))
    words, vocabulary, tokens = number_words(rows, uri, shards, size // (6 * 4 * shards), lambda texts: stream(texts, 1)[0], BLOCK_BYTES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(shards)

        def flush() -> Iterator[pa.RecordBatch]:
            if (taken := held.take()) is not None:
                yield from sent_rows(list(send(f"grams{order}", shards, words.route(taken[0]), [*taken[0], taken[1]]))).to_batches()

        try:
            for block in blocks(batches, "body", BLOCK_BYTES):
                hashes, at, _ = stream(block.column(0), order)
                kinds, back = np.unique(hashes, return_inverse=True)
                number = words.of(kinds)[2]  # 0 for the opening mark, as all words are known
                if held.add(*_counted(number[back.reshape(-1)], at, order)):
                    yield from flush()
            yield from flush()
        finally:
            forget()

    def merge(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        blobs = table.column("blob").to_pylist()
        if kind.startswith("spread"):
            key, *sums = sum_by(*receive(blobs, 5))
            write_table(uri, table_name(kind, shard), key, sums)
            return sent_rows([])
        k = int(kind.removeprefix("grams"))
        *columns, counts = receive(blobs, k + 1)
        columns, counts = distinct_rows(columns, counts)
        names = [mix(c) for c in columns]
        write_table(uri, table_name(kind, shard), row_hashes(names), [counts])
        sums = [(kind, [*(int((counts == j).sum()) for j in (1, 2, 3, 4)), int(counts.sum())])]
        if k == 1:
            return sent_rows([], sums)
        head = np.ones(len(counts), bool)
        head[1:] = False
        for c in columns[:-1]:
            head[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(head)
        context = row_hashes([n[at] for n in names[:-1]])
        of = [np.add.reduceat(x, at) for x in (counts, *((counts == j).astype(np.uint64) for j in (1, 2)), (counts > 2).astype(np.uint64))]
        spread = words.spread([c[at] for c in columns[:-1]])
        write_table(uri, table_name(f"context{k}", shard), context[~spread], [x[~spread] for x in of])
        context, *of = sum_by(context[spread], *(x[spread] for x in of))
        sent = list(send(f"spread{k}", shards, shard_of(context, shards), [context, *of]))
        lower = columns[1:]
        add = np.where(lower[0] == 0, counts, 1).astype(np.uint64) if k > 2 else np.ones(len(counts), np.uint64)
        lower, add = distinct_rows(lower, add)
        sent += send(f"grams{k - 1}", shards, words.route(lower), [*lower, add])
        return sent_rows(sent, sums)

    sent = rows.mapInArrow(count, KIND)
    counts: dict[int, list[int]] = {}
    kinds = 0
    for k in range(order, 0, -1):
        done = landed(sent.groupBy("kind", "shard").applyInArrow(merge, KIND), uri, f"sent{k}")
        sums = done.filter(F.col("kind") == f"grams{k}").filter("sums IS NOT NULL").agg(*[F.sum(F.col("sums")[i]) for i in range(5)]).first()
        if sums[0] is not None:
            counts[k] = list(sums[:4])
            kinds = sums[4]
        if k < order:  # the shards have read these rows; sums of frequent contexts are merged with the next order
            remove_dir(f"{uri}/sent{k + 1}")
        sent = done.filter("blob IS NOT NULL")
    return Model(words, order, counts, kinds, tokens, vocabulary)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; perplexity is 10 ** (-score / n_tokens)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for block in blocks(batches, "body", BLOCK_BYTES):
                count, known, base, own = model.scores(block.column(1))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(count), pa.array(known), pa.array(base), pa.array(own)], ["id", "n_tokens", "n_known", "base_score", "score"])
        finally:
            forget()

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(scan, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def lm_query(docs: DataFrame, order: int = ORDER) -> DataFrame:
    model = fit(docs.filter(remainder("doc_id", 7) != 2), order=order)
    found = score(docs.select("doc_id", "text"), model)
    return found.select(
        F.col("id").alias("doc_id"), (remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
