"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

Two words are one edit apart at position i if they share what comes before it and what comes after it. With words in
order and reversed words in order, the first is a range of the one order and the second a range of the other; the words
in both are points in a rectangle, which a wavelet tree over the reversed ranks reports without looking at the rest.

Words are dealt by the half that the edit leaves alone, so that a task holds a bounded part of the vocabulary. A half
that too many words share is dealt again by three quarters of the word, and so on: the places left for the edit halve.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linehaul.llm.frames import bounded
from linehaul.scratch import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A run's characters: all of them are one byte in Latin-1.
RUN = r"[A-Za-zÀ-ÿ]"
_KEY = ["m", "a", "b", "key"]


class Wavelet:
    """A wavelet tree, level by level, over a permutation; reports the points of many rectangles at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each place in [lo, hi) whose value is in [low, high)."""
        rect = np.flatnonzero((lo < hi) & (low < high))
        lo, hi, least = lo[rect], hi[rect], np.zeros(len(rect), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            l0, h0 = zeros[lo], zeros[hi]
            rect, least = np.concatenate([rect, rect]), np.concatenate([least, least + half])
            lo, hi = np.concatenate([l0, zeros[-1] + lo - l0]), np.concatenate([h0, zeros[-1] + hi - h0])
            go = np.flatnonzero((lo < hi) & (least < high[rect]) & (least + half > low[rect]))
            rect, least, lo, hi = rect[go], least[go], lo[go], hi[go]
        return rect, least


class Order:
    """Rows of a byte matrix in order within their groups, and the ranges that share their first bytes."""

    def __init__(self, group: np.ndarray, rows: np.ndarray):
        wide = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
        self.at = np.argsort(np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel(), kind="stable")
        self.place = np.empty(len(self.at), np.int64)
        self.place[self.at] = np.arange(len(self.at))
        g, r = group[self.at], rows[self.at]
        same = np.concatenate([r[1:] == r[:-1], np.zeros((max(len(r) - 1, 0), 1), bool)], axis=1)
        self.shared = np.where(g[1:] == g[:-1], np.argmin(same, axis=1), -1)  # bytes that a row shares with the one before

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By place: the range of places of rows that share ``depth`` bytes with it."""
        first = np.flatnonzero(np.concatenate([[True], self.shared < depth]))
        size = np.diff(np.append(first, len(self.at)))
        return np.repeat(first, size), np.repeat(first + size, size)


def neighbours(short: np.ndarray, long: np.ndarray, group_s: np.ndarray, group_l: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the pairs one edit apart among words of m bytes and of m + 1, those of one group, edited in places a to b.

    Rows of ``long`` are numbered after those of ``short``. Pairs of ``short`` words come in both directions, others
    from the short one. The place of an edit is the number of bytes that the two share from the left, so that every
    pair has one; the place m, behind the short word, belongs to the window that ends there.
    """
    ns, m = short.shape
    pad = np.concatenate([short, np.zeros((ns, 1), np.uint8)], axis=1)
    back = np.concatenate([short[:, ::-1], np.zeros((ns, 1), np.uint8)], axis=1)
    group = np.concatenate([group_s, group_l])
    there, back = Order(group, np.concatenate([pad, long])), Order(group, np.concatenate([back, long[:, ::-1]]))
    out = []
    for mine, edits in ((np.arange(ns), 1), (np.arange(ns, len(group)), 0)):
        if not len(mine):
            continue
        lower, upper = mine[0], mine[-1]
        # ranks among the words looked for: of a range its ends
        inside = [np.concatenate([[0], np.cumsum((o.at >= lower) & (o.at <= upper))]) for o in (there, back)]
        rank = inside[1][back.place[mine]]
        tree = Wavelet(rank[there.at[(there.at >= lower) & (there.at <= upper)] - lower])
        by_rank = mine[np.argsort(rank)]
        asked = []
        for i in range(a, b + (b == m and not edits)):
            (x0, x1), (y0, y1) = there.ranges(i), back.ranges(m - i - edits)
            p, r = there.place[:ns], back.place[:ns]
            lo, hi, low, high = inside[0][x0[p]], inside[0][x1[p]], inside[1][y0[r]], inside[1][y1[r]]
            go = np.flatnonzero((hi - lo > edits) & (high - low > edits))  # a word is in its own rectangle if lengths are equal
            asked.append((go, np.full(len(go), i), lo[go], hi[go], low[go], high[go]))
        if not asked:
            continue
        word, at, lo, hi, low, high = (np.concatenate(x) for x in zip(*asked, strict=True))
        rect, value = tree.report(lo, hi, low, high)
        one, two, at = word[rect], by_rank[value], at[rect]
        other = short[two, np.minimum(at, m - 1)] if edits else long[two - ns, at]
        new = (at == m) | (short[one, np.minimum(at, m - 1)] != other)
        out.append((one[new], two[new]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(words: pa.Array, width: int) -> np.ndarray:
    """Latin-1 bytes of words of one length."""
    return np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, width)


_NEAR = "word string, n_near long, best_n long, best string"


def _near(table: pa.Table) -> pa.Table:
    """Of the words of a shard the near ones in it: how many, and the most frequent."""
    table = table.combine_chunks()
    m, a, b, n = (table[c].to_numpy() for c in ("m", "a", "b", "n"))
    words, size = table["word"].chunk(0) if table.num_rows else pa.array([], pa.string()), table["size"].to_numpy()
    key = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((size, b, a, m))
    edge = np.flatnonzero(np.concatenate([[True], np.any([np.diff(x[order]) != 0 for x in (m, a, b)], axis=0)]))
    rows = []
    for lo, hi in zip(edge, np.append(edge[1:], len(order)), strict=True):
        own, length = order[lo:hi], int(m[order[lo]])
        ns = int((size[own] == length).sum())  # the short ones come first
        short, long = _matrix(words.take(pa.array(own[:ns])), length), _matrix(words.take(pa.array(own[ns:])), length + 1)
        one, two = neighbours(short, long, key[own[:ns]], key[own[ns:]], int(a[own[0]]), int(b[own[0]]))
        far = two >= ns
        rows.append((own[np.concatenate([one, two[far]])], own[np.concatenate([two, one[far]])]))
    one, two = (np.concatenate(x) for x in zip(*rows, strict=True))
    # the most frequent first, of equal ones the smallest; a shard's row is a word in one bucket
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    go = np.lexsort((rank[two], -n[two], one))
    one, two = one[go], two[go]
    first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]])) if len(one) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(one)))
    return pa.table({"word": words.take(pa.array(one[first])), "n_near": pa.array(count, pa.int64()), "best_n": pa.array(n[two[first]], pa.int64()), "best": words.take(pa.array(two[first]))})


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: runs of letters of whole texts, A-Z lower-cased; of some runs of some documents one character is left out.

    A run is changed where ``every`` divides the crc32 of ``<doc_id>:<run>``, at that number modulo its length; runs of
    a null id stay as they are.
    """
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{least_length},}})"), F.lit(1)))
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), runs.alias("run")).select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _bucket(m: Column, a: Column, b: Column) -> Column:
    """The bucket of ``word`` for edits in places a to b between words of m and m (+ 1) characters: what lies before and behind."""
    key = F.concat(F.left("word", a), F.lit(" "), F.right("word", m - b))
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"), key.alias("key"))


def buckets(words: DataFrame, most: int, scratch: Scratch, least_length: int = 7) -> tuple[DataFrame, int]:
    """(``words`` (word, n) with their length and buckets, number of rows): of no bucket more than ``most`` rows, if it can be cut further.

    A word is the shorter or an equal partner in buckets of its own length and the longer one in those of one less. A
    window of a single place ends the cutting: what shares all the rest differs in one or two characters.
    """
    zero, size = F.lit(0), F.length("word")
    halves = lambda m: [_bucket(m, zero, F.floor(m / 2)), _bucket(m, F.floor(m / 2), m)]
    both = F.when(size > least_length, F.array(*halves(size - 1), *halves(size))).otherwise(F.array(*halves(size)))
    open_ = words.select("word", "n", size.alias("size"), F.explode(both).alias("k")).select("word", "n", "size", "k.*")
    done, total = [], 0
    while True:
        sizes = scratch.table(open_.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows")), "sizes")
        large = scratch.table(sizes.where((F.col("rows") > most) & (F.col("b") - F.col("a") > 1)).select(*_KEY), "large")
        total += sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).collect()[0]["n"]
        if not large.limit(1).count():
            done.append(open_)
            break
        few = bounded(large, 1_000_000)
        done.append(open_.join(few, _KEY, "left_anti"))
        mid, m, a, b = F.floor((F.col("a") + F.col("b")) / 2), F.col("m"), F.col("a"), F.col("b")
        cut = open_.join(few, _KEY, "left_semi").select("word", "n", "size", F.explode(F.array(_bucket(m, a, mid), _bucket(m, mid, b))).alias("k"))
        open_ = scratch.table(cut.select("word", "n", "size", "k.*"), "cut")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, total


def near_words(words: DataFrame, scratch: Scratch, most: int = 20_000, least_length: int = 7) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``words`` (word, n) with a near one: how many there are, and the most frequent.

    Of equally frequent ones ``best`` is the smallest. Words have at least ``least_length`` characters, all in Latin-1.
    """
    rows, total = buckets(words, most, scratch, least_length)
    # a shard holds some buckets of bounded size each
    shards = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (2 * most) + 1)
    shard = F.pmod(F.xxhash64(*_KEY), F.lit(shards)).cast("int")
    found = rows.withColumn("shard", shard).groupBy("shard").applyInArrow(lambda t: _near(t), _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of ``forms`` (word, form): the end of the chain of forms. A form's count is a multiple of its word's, so that chains are short and end."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.toDF("_word", "_root")
        now = scratch.table(now.join(then, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, times: int = 10, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word of ``word_counts``.

    Near words differ by one inserted, deleted or replaced character. ``form``: the near word of largest n, of equal
    ones the smallest in code-point order, if that n is at least ``times`` the word's; else null. ``root``: the last
    word on the way from form to form, the word itself without one. Null and empty texts have no words; very long ones
    are read whole; repeated rows count as often as they occur. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(word_counts(docs, least_length, least_count, every), "words")
    near = near_words(words, scratch, least_length=least_length)
    formed = F.col("best_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    rows = scratch.table(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL"), scratch)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
