"""Byte-level BPE: encoding through a lexicon automaton, exact merges for what it lacks, and decoding.

Words (the pieces that the pre-tokenizer cuts) are counted over all texts. The frequent ones go into a minimal acyclic
transducer: words share beginnings and endings, and numbers on the transitions add up to the word's place in a list of
token ids. It is built on the driver from a bounded number of words, written to the shared folder and mapped by workers.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linehaul.llm import kernels as K
from linehaul.llm.mapped import Probed, open_arrays, write_arrays
from linehaul.scratch import Scratch

U = np.uint64
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Words of more bytes are merged and not looked up.
LONGEST = 64
#: Words of more bytes are merged one by one with a heap, as the steps of all words of a piece are made together.
TOGETHER = 256
_NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed by the format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def code_point_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE for each code point, as the tokenizer's own patterns have them."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        cut = pre_tokenizers.Split(Regex(pattern), "isolated")
        for k in range(0, len(points), 512):
            found = [ord(x) for x, _ in cut.pre_tokenize_str("\0".join(points[k : k + 512])) if len(x) == 1 and x != "\0"]
            out[found] = kind
    return out


class Vocabulary:
    """What encoding needs of a tokenizer file: bytes of each token, merges in order, tokens that are added whole."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"] or {}
        wrong = [
            file["normalizer"], model["type"] != "BPE", model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"),
            before.get("type") != "ByteLevel", before.get("add_prefix_space"), not before.get("use_regex", True), (file["decoder"] or {}).get("type") != "ByteLevel",
            any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] or not t["content"] for t in file["added_tokens"]),
        ]
        if any(wrong):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        byte = {c: b for b, c in enumerate(byte_symbols())}
        self.added = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        ids = {t: i for t, i in model["vocab"].items()}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in ids.items():
            self.tokens[i] = bytes(byte[c] for c in t)
        for t, i in self.added.items():
            self.tokens[i] = t
        self.first = np.array([ids[c] for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)

    def arrays(self) -> dict[str, np.ndarray]:
        key = (self.pairs[:, 0].astype(U) << U(32)) | self.pairs[:, 1].astype(U)
        key, first = np.unique(key, return_index=True)
        pairs = Probed.build(key, (first.astype(np.int64) << 24) | self.pairs[first, 2])
        sizes = np.array([len(t) for t in self.tokens], np.int64)
        added = json.dumps([[t.hex(), i] for t, i in self.added.items()]).encode()
        return {"first": self.first, "pair_keys": pairs.keys, "pair_values": pairs.values, "token_end": np.cumsum(sizes), "token_bytes": np.frombuffer(b"".join(self.tokens), np.uint8), "classes": code_point_classes(), "added": np.frombuffer(added, np.uint8)}


def transducer(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(transitions, values, final states, start) of the minimal acyclic automaton of sorted distinct words.

    A transition is state << 8 | byte, its value next state << 32 | number of words that sort before those it leads
    to; the numbers along a word add up to its place. States that accept the same endings are one.
    """
    states: dict[tuple, int] = {}
    below: list[int] = []  # words accepted from a state
    edges: list[tuple[int, int, int, int]] = []
    final: list[bool] = []

    def close(accepts: bool, out: list[tuple[int, int]]) -> int:
        key = (accepts, tuple(out))
        if key not in states:
            states[key] = state = len(below)
            n = int(accepts)
            for byte, to in out:
                edges.append((state, byte, to, n))
                n += below[to]
            below.append(n)
            final.append(accepts)
        return states[key]

    open_: list[list] = [[False, []]]  # along the last word: does it accept, its closed transitions
    last = b""
    for word in [*words, b""]:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        for depth in range(len(last), same, -1):
            accepts, out = open_.pop()
            open_[-1][1].append((last[depth - 1], close(accepts, out)))
        open_ += [[False, []] for _ in range(len(word) - same)]
        if word:
            open_[-1][0] = True
        last = word
    start = close(*open_[0])
    e = np.array(edges, np.int64).reshape(-1, 4)
    return (e[:, 0] << 8) | e[:, 1], (e[:, 2] << 32) | e[:, 3], np.array(final, bool), start


class Encoder:
    """Encoding and decoding with the arrays of a written model."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.pairs = Probed(arrays["pair_keys"], arrays["pair_values"])
        self.added = {bytes.fromhex(t): i for t, i in json.loads(arrays["added"].tobytes())}
        self._added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.token_start = np.concatenate([[0], arrays["token_end"]])
        if "edge_keys" in arrays:
            self.edges = Probed(arrays["edge_keys"], arrays["edge_values"])

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id of an added token or -1) of the words of texts, by byte, in order; no word crosses a text's end.

        The pattern is that of byte-level BPE: ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+``.
        """
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        at, point = code_points(data)
        kind = self.a["classes"][point]
        m = len(at)
        hard = np.zeros(m + 1, bool)  # a segment begins here
        hard[np.searchsorted(at, offsets)] = True
        hard[0] = hard[m] = True
        whole = np.full(m, -1, np.int64)
        if self._added:
            inner, text_end = data.tobytes(), offsets
            for x in self._added.finditer(inner) if any(t in inner for t in self.added) else ():
                lo, hi = x.span()
                if text_end[np.searchsorted(text_end, lo, "right")] >= hi:
                    i, j = np.searchsorted(at, [lo, hi])
                    hard[i] = hard[j] = True
                    whole[i] = self.added[x.group()]
                    kind[i:j] = OTHER
        start = hard.copy()
        start[1:m] |= kind[1:] != kind[:-1]
        blank = (point == 32) & (whole < 0)
        space = kind == SPACE
        # a run of white space leaves its last character to what follows, and a blank joins it
        i = np.flatnonzero(space[:-1] & ~space[1:] & ~hard[1:m])
        start[i] = True
        start[i[blank[i]] + 1] = False
        # an apostrophe alone, neither after a blank nor after other signs, takes up the letters of a contraction
        i = np.flatnonzero((point == 39) & (whole < 0))
        if len(i):
            after = np.append(point, [0, 0, 0])
            open_ = ~np.append(hard, [True, True])
            i = i[start[i] & open_[i + 1]]  # begins its word and is not the last of its segment; after a blank it does not begin it
            one, two = after[i + 1], np.where(open_[i + 2], after[i + 2], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            i, size = i[short | long], np.where(short, 2, 3)[short | long]
            start[i + 1] = False
            start[i + size] = True
        s = np.flatnonzero(start[:m])
        ends = np.append(at[s[1:]], n)
        return at[s], ends, whole[s]

    def look_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of words in the lexicon, -1 where it lacks them: all words take a step at a time."""
        place = np.full(len(start), -1, np.int64)
        size = end - start
        go = np.flatnonzero(size <= LONGEST)
        state, sums, step = np.full(len(go), int(self.a["start"][0]), np.int64), np.zeros(len(go), np.int64), 0
        while len(go):
            v = self.edges.get(((state << 8) | data[start[go] + step]).astype(U), -1)
            step += 1
            ok = v >= 0
            go, state, sums = go[ok], v[ok] >> 32, sums[ok] + (v[ok] & 0xFFFFFFFF)
            ends = size[go] == step
            done = ends & self.a["final"][state]
            place[go[done]] = sums[done]
            go, state, sums = go[~ends], state[~ends], sums[~ends]
        return place

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them for each word) of words by merging: the earliest pair first, from the left."""
        size = end - start
        ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(start)
        few = np.flatnonzero(size <= TOGETHER)
        for k in np.flatnonzero(size > TOGETHER):
            ids[k] = self._merge_one(data[start[k] : end[k]])
        token, of = self.a["first"][data[K.ranges(start[few], size[few])]], np.repeat(few, size[few])
        done = [(of[:0], token[:0])]
        while len(token):
            key = (token[:-1].astype(U) << U(32)) | token[1:].astype(U)
            v = np.append(self.pairs.get(key, _NONE), _NONE)
            v[:-1][of[:-1] != of[1:]] = _NONE
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.repeat(np.minimum.reduceat(v, edge), np.diff(np.append(edge, len(v))))
            ended = least == _NONE
            if ended.any():
                done.append((of[ended], token[ended]))
            hit = (v == least) & ~ended
            # of equal pairs that overlap the first, third and so on
            place = np.arange(len(hit))
            since = place - np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, -1))
            hit &= since % 2 == 0
            token = np.where(hit, v & 0xFFFFFF, token)
            keep = ~ended
            keep[1:] &= ~hit[:-1]
            token, of = token[keep], of[keep]
        of, token = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(start))
        if len(few) < len(start):
            parts = np.split(token[order], np.cumsum(count)[:-1])
            ids = [p if len(p) else i for p, i in zip(parts, ids, strict=True)]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        return token[order], count

    def _merge_one(self, word: np.ndarray) -> np.ndarray:
        """One long word: pairs in a heap, neighbours in a linked list."""
        token = self.a["first"][word].tolist()
        n = len(token)
        key = lambda a, b: np.array([(a << 32) | b], U)
        known: dict[tuple[int, int], int] = {}

        def pair(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.pairs.get(key(a, b), -1)[0])
            return known[a, b]

        then, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(v >> 24, i, v, token[i], token[i + 1]) for i in range(n - 1) if (v := pair(token[i], token[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, v, a, b = heapq.heappop(heap)
            j = then[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = v & 0xFFFFFF, -1
            then[i] = then[j]
            if then[i] < n:
                ahead[then[i]] = i
            for x, y in ((ahead[i], i), (i, then[i])):
                if x >= 0 and y < n and (w := pair(token[x], token[y])) >= 0:
                    heapq.heappush(heap, (w >> 24, x, w, token[x], token[y]))
        return np.array([t for t in token if t >= 0], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of texts into them)."""
        start, end, whole = self.cut(data, offsets)
        place = np.where(whole < 0, self.look_up(data, start, end), -1)
        known, new = place >= 0, (place < 0) & (whole < 0)
        lo = np.concatenate([[0], self.a["word_end"]])
        count = np.ones(len(start), np.int64)
        count[known] = lo[place[known] + 1] - lo[place[known]]
        merged, sizes = self.merge(data, start[new], end[new])
        count[new] = sizes
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        ids[at[whole >= 0]] = whole[whole >= 0]
        ids[K.ranges(at[known], count[known])] = self.a["word_ids"][K.ranges(lo[place[known]], count[known])]
        ids[K.ranges(at[new], sizes)] = merged
        return ids, np.append(at, len(ids))[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of tokens, special ones included."""
        start = self.token_start[ids]
        return self.a["token_bytes"][K.ranges(start, self.token_start[ids + 1] - start)].tobytes()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of each character of UTF-8 bytes."""
    if not (data & 0x80).any():
        return np.arange(len(data)), data.astype(np.int32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.append(data, [0, 0, 0]).astype(np.int32)
    lead, x, y, z = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | x, np.where(lead < 0xF0, (lead & 15) << 12 | x << 6 | y, (lead & 7) << 18 | x << 12 | y << 6 | z)))
    return at, point


_STRETCH = 1 << 22


def stretches(data: np.ndarray, most: int = _STRETCH) -> Iterator[tuple[int, int]]:
    """Parts of one text of about ``most`` bytes, cut before a blank that follows an ASCII letter, where a word always ends."""
    lo, n = 0, len(data)
    while n - lo > most:
        at, step = lo + most, most
        while at < n:
            part = data[at - 1 : at + step]
            cut = np.flatnonzero((part[1:] == 32) & ((part[:-1] | 32) - np.uint8(97) < 26))
            if len(cut):
                at += int(cut[0])
                break
            at += step
        if at >= n:
            break
        yield lo, at
        lo = at
    yield lo, n


def parts_of(col: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first text, past the last, bytes, offsets, is it the end of them) over a column; a long text comes in stretches."""
    data, offsets = K.text_bytes(col)
    for i, j in K.pieces(offsets, most):
        piece = data[offsets[i] : offsets[j]]
        if len(piece) > _STRETCH and j == i + 1:
            for lo, hi in stretches(piece):
                yield i, j, piece[lo:hi], np.array([0, hi - lo]), hi == len(piece)
        else:
            yield i, j, piece, offsets[i : j + 1] - offsets[i], True


def count_words(docs: DataFrame, uri: str, flush: int = 300_000) -> DataFrame:
    """``(word, n)`` over the whole ``text`` of all ``docs``; a task hands its sums on whenever it holds ``flush`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            encoder = Encoder(open_arrays(uri))
            for _, _, data, offsets, _ in parts_of(b.column(0)):
                start, end, whole = encoder.cut(data, offsets)
                plain = (whole < 0) & (end - start <= LONGEST)
                start, end = start[plain], end[plain]
                # equal 64-bit hashes only put words into one count; what is encoded does not depend on it
                h = K.span_hash(data.astype(U) + U(1), start, end, K._BYTE_R)
                _, one, n = np.unique(h, return_index=True, return_counts=True)
                raw = data.tobytes()
                for lo, hi, k in zip(start[one].tolist(), end[one].tolist(), n.tolist(), strict=True):
                    w = raw[lo:hi]
                    held[w] = held.get(w, 0) + k
                if len(held) >= flush:
                    yield out()
                    held = {}
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> list[bytes]:
    """The words counted twice or more, down to a count at which no more than ``most`` are left, in byte order.

    Counts fall into sixteenths of powers of two, of which there are less than a thousand; a whole class goes in or stays out.
    """
    kind = F.floor(F.log2("n") * 16).cast("int")
    kinds = counts.where("n >= 2").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for r in sorted(kinds, key=lambda r: -r["kind"]):
        total += r["words"]
        if total > most:
            break
        least = r["kind"]
    if least is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.where("n >= 2").where(kind >= least).select("word").collect())


def compiled(vocabulary: Vocabulary, words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of a model whose lexicon has the sorted distinct ``words``."""
    arrays = vocabulary.arrays()
    keys, values, final, start = transducer(words)
    edges = Probed.build(keys.astype(U), values)
    sizes = np.array([len(w) for w in words], np.int64)
    ids, n = Encoder(arrays).merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, np.cumsum(sizes))
    return arrays | {"edge_keys": edges.keys, "edge_values": edges.values, "final": final, "start": np.array([start]), "word_end": np.cumsum(n), "word_ids": ids}


def lexicon(docs: DataFrame, path: str, most_words: int = 1 << 17, scratch: Scratch | None = None) -> str:
    """Writes the model of ``path`` with the frequent words of ``docs`` to the shared folder and returns its address.

    The driver holds at most ``most_words`` words of at most ``LONGEST`` bytes.
    """
    scratch = scratch or Scratch(docs.sparkSession, "bpe")
    vocabulary = Vocabulary(path)
    bare = f"{scratch.root}/bare"
    write_arrays(bare, vocabulary.arrays())
    words = frequent_words(scratch.table(count_words(docs, bare), "words"), most_words)
    write_arrays(f"{scratch.root}/lexicon", compiled(vocabulary, words))
    return f"{scratch.root}/lexicon"


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of '0,1,2,', end of each number with its comma)."""
    text = [f"{k},".encode() for k in range(size)]
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum([len(t) for t in text])


def encode(docs: DataFrame, uri: str) -> DataFrame:
    """``docs`` (doc_id, text) as ``(doc_id, ids)``; a text's ids come in one row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder, held = Encoder(open_arrays(uri)), []
            for i, j, data, offsets, last in parts_of(b.column(1)):
                ids, edge = encoder.encode(data, offsets)
                held.append(ids)
                if last:
                    all_ids = np.concatenate(held)
                    edge = edge if len(held) == 1 else np.array([0, len(all_ids)])
                    yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(all_ids, pa.int32()))], ["doc_id", "ids"])
                    held = []

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, uri: str) -> DataFrame:
    """``(doc_id, ids)`` as ``(doc_id, text)``; bytes that are no UTF-8 are replaced, null ids give the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoder = Encoder(open_arrays(uri))
            texts = [encoder.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digest(docs: DataFrame, path: str, most_words: int = 1 << 17) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``: ids joined by commas, and the text they decode to.

    Null and empty texts have no tokens and the digest of the empty text twice. A very long text is cut where a word
    ends, so that memory stays bounded, and its digests are carried on. Repeated rows, null ids and ties of counts
    change nothing: the lexicon speeds up encoding and never decides an id. An empty table gives an empty result.
    """
    uri = lexicon(docs, path, most_words)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = None
        for b in batches:
            encoder = Encoder(open_arrays(uri))
            text, ends = digits = digits or _decimals(len(encoder.a["token_end"]))
            begins = np.concatenate([[0], ends])
            n, one, two, state = [], [], [], None
            for _, _, data, offsets, last in parts_of(b.column(1)):
                ids, edge = encoder.encode(data, offsets)
                for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    mine = ids[lo:hi]
                    joined = text[K.ranges(begins[mine], begins[mine + 1] - begins[mine])].tobytes()
                    count, a, z = state or (0, hashlib.sha256(), hashlib.sha256())
                    a.update((b"," if count and joined else b"") + joined[:-1])
                    z.update(encoder.decode(mine))
                    state = (count + hi - lo, a, z)
                    if last:
                        n.append(state[0])
                        one.append(a.hexdigest())
                        two.append(z.hexdigest())
                        state = None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
