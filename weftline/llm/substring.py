"""Substring deduplication: remove every word that a repeated window of words covers.

The reference is the corpus itself, so its suffix automata cannot be sent to every task. Instead the
reference is sharded so that whatever can match meets in one shard, and only shards with something to
match are built:

1. In each window of SPAN words the k-gram with the smallest hash is its anchor. Equal windows have equal
   anchors at equal offsets, and a run of windows shares one anchor, so that anchors are few. Anchors
   that occur once are left out: their windows occur once.
2. A run of windows with a repeated anchor is a context: the words that its windows cover. Equal contexts
   are counted where they are read. Contexts meet in the shard of their anchor; for an anchor that
   occurs very often each window is a context of its own, with its own shard.
3. Each shard's contexts go into a generalised suffix automaton with occurrence counts. Streaming the
   contexts through it gives matching statistics, cut to SPAN words; a window whose state occurs twice
   or more is repeated. Words are compared as they are: hashes only route.
4. Repeated windows go back to their documents, which drop the words that they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, text_batches
from weftline.llm.licenses import SuffixAutomaton
from weftline.llm.ngram_join import id_sketch, sketched
from weftline.llm.textcodes import ngram_hashes, word_hashes

SPAN = 35
K = 8
#: An anchor that occurs more often has a shard for each of its windows.
OFTEN = 2000
#: Bits of the filter of repeated anchors, and how many anchors it may hold.
FILTER_BITS, MOST_ANCHORS = 1 << 24, 1 << 21


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def anchors(text: str | None, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """For each run of windows with one anchor: the anchor's hash and the first window's start; and
    the number of windows."""
    words = word_hashes(text)
    n = len(words) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    grams = ngram_hashes(words, k)
    at = sliding_window_view(grams, span - k + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
    return grams[at[first]].view(np.int64), first, n


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _short(sha: str) -> int:
    """What tells the texts of one id apart."""
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


def _told_apart(docs: DataFrame) -> DataFrame:
    """With ``of``, which tells the texts of one id apart in a join without reading their words."""
    return docs.withColumn("of", F.xxhash64("text"))


def _anchored(docs: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, shas, grams = [], [], []
            for text in batch["text"]:
                words = split_words(text)
                sizes.append(len(words))
                shas.append(_sha(words))
                grams.append(anchors(text, span)[0])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "of": batch["of"], "n_words": sizes, "sha": shas, "g": grams})

    return _told_apart(docs).mapInPandas(run, "doc_id string, of bigint, n_words bigint, sha string, g array<bigint>")


_CONTEXT = "doc_id string, sha bigint, at int, shard bigint, digest binary, n bigint, words binary"
#: Contexts that a task counts before it hands them on.
COUNTED = 100_000


def _contexts(docs: DataFrame, repeated: Repeated, span: int) -> DataFrame:
    """Rows of two kinds: a place of a context (doc_id, sha, at, shard, digest), and, without a doc_id, a
    context with its words and how often the task has met it so far (shard, digest, n, words)."""
    columns = [c.split()[0] for c in _CONTEXT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, list] = {}
        out: list[tuple] = []

        def handed_on() -> Iterator[pd.DataFrame]:
            rows = [(None, None, None, shard, digest, n, own) for digest, (shard, n, own) in counts.items()]
            counts.clear()
            for k in range(0, len(rows), 10_000):
                yield pd.DataFrame(rows[k : k + 10_000], columns=columns)

        for batch in batches:
            for row in batch.itertuples(index=False):
                grams, first, n = anchors(row.text, span)
                if repeated.bits is not None:
                    which = np.flatnonzero(repeated.holds(grams)).tolist()
                    often = repeated.frequent
                else:
                    # Marks hold for this text only where they name its own anchor.
                    own = [m for m in row.marks if m["j"] < len(grams) and grams[m["j"]] == m["g"]]
                    which = sorted({m["j"] for m in own})
                    often = {m["g"] for m in own if m["often"]}
                if not which:
                    continue
                words = split_words(row.text)
                sha = _short(_sha(words))
                starts, keys = [*first.tolist(), n], grams.tolist()
                for j in which:
                    a, b, split = starts[j], starts[j + 1], keys[j] in often
                    for start in range(a, b) if split else (a,):
                        own = b" ".join(words[start : (start + 1 if split else b) - 1 + span])
                        digest = hashlib.blake2b(own, digest_size=16).digest()
                        known = counts.get(digest)
                        if known is None:
                            known = counts[digest] = [int.from_bytes(digest[:8], "little", signed=True) if split else keys[j], 0, own]
                        known[1] += 1
                        out.append((row.doc_id, sha, start, known[0], digest, None, None))
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
                if len(counts) > COUNTED:
                    yield from handed_on()
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield from handed_on()

    return docs.mapInPandas(run, _CONTEXT)


@dataclass
class Repeated:
    """The anchors that occur more than once, as a Bloom filter of two bits, and those that occur often.

    Built only while they are at most MOST_ANCHORS; without bits, anchors are found by a join.
    """

    bits: np.ndarray | None
    frequent: frozenset[int]

    @staticmethod
    def places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return grams & (FILTER_BITS - 1), (grams >> 32) & (FILTER_BITS - 1)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        a, b = self.places(grams)
        return ((self.bits[a >> 6] >> (a & 63)) & (self.bits[b >> 6] >> (b & 63)) & 1).astype(bool)

    @classmethod
    def of(cls, repeated: DataFrame, n: int, most: int) -> Repeated:
        if n > most:
            return cls(None, frozenset())
        a, b = F.col("g").bitwiseAND(FILTER_BITS - 1), F.shiftright("g", 32).bitwiseAND(FILTER_BITS - 1)
        at = repeated.select(F.explode(F.array(a, b)).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        rows = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(one).alias("x")).toPandas()
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        bits[rows["w"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64)
        return cls(bits, frozenset(repeated.filter("often").select("g").toPandas()["g"].tolist()))


def repeated_windows(contexts: list[bytes], counts: list[int], span: int = SPAN) -> list[int]:
    """For each context, the bits of its windows that occur twice or more among all contexts."""
    if len(contexts) == 1:
        return [(1 << contexts[0].count(b" ") + 2 - span) - 1 if counts[0] > 1 else 0]
    ids: dict[bytes, int] = {}
    coded = [[ids.setdefault(w, len(ids)) for w in c.split(b" ")] for c in contexts]
    a = SuffixAutomaton(coded, notes=False)
    times = [0] * len(a.link)
    for seq, n in zip(coded, counts, strict=True):
        state = 0
        for c in seq:
            state = a.next[state][c]
            times[state] += n
    for state in sorted(range(1, len(a.link)), key=a.length.__getitem__, reverse=True):
        times[a.link[state]] += times[state]
    out = []
    for seq in coded:
        state, bits = 0, 0
        for i, c in enumerate(seq):
            state = a.next[state][c]
            while a.length[a.link[state]] >= span:  # cut the match to a window
                state = a.link[state]
            if i >= span - 1 and times[state] > 1:
                bits |= 1 << i - span + 1
        out.append(bits)
    return out


def _judged(span: int):
    """Rows of a partition sorted by shard; a context comes once from each task that met it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held = None, {}

        def judge() -> list[tuple]:
            bits = repeated_windows([w for w, _ in held.values()], [n for _, n in held.values()], span)
            return [(shard, digest, b) for digest, b in zip(held, bits, strict=True) if b]

        for batch in batches:
            out = []
            for s, digest, words, n in zip(batch["shard"], batch["digest"], batch["words"], batch["n"], strict=True):
                if s != shard:
                    if held:
                        out += judge()
                    shard, held = s, {}
                held[digest] = words, n + (held[digest][1] if digest in held else 0)
            yield pd.DataFrame(out, columns=["shard", "digest", "bits"])
        if held:
            yield pd.DataFrame(judge(), columns=["shard", "digest", "bits"])

    return run


def _cut(span: int, texts: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, sha, text, hits in zip(batch["doc_id"], batch["sha"], batch["text"], batch["hits"], strict=True):
                words = split_words(text)
                if _short(_sha(words)) != sha:  # another text of the same id
                    continue
                edge = np.zeros(len(words) + 1, np.int32)
                for hit in hits:
                    bits, start = hit["bits"], hit["at"]
                    while bits:
                        low = (bits & -bits).bit_length() - 1
                        edge[start + low] += 1
                        edge[start + low + span] -= 1
                        bits &= bits - 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc, sha, int(gone.sum()), _sha(kept), b" ".join(kept).decode("utf-8", "replace") if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "sha", "n_removed", "kept_sha256", "kept"])

    return run


def _text_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ``ids`` (id), and perhaps some others; no shuffle."""
    sketch = id_sketch(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[sketched(sketch, batch.pop("bit").to_numpy(np.int64))]

    return docs.withColumn("bit", F.xxhash64("doc_id")).mapInPandas(run, "doc_id string, text string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, texts: bool = False, most_anchors: int = MOST_ANCHORS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (with ``texts``, also the kept words,
    null where nothing goes).

    A null text has no words. A text repeats itself where a window stands in it twice, so overlapping
    copies inside one text count. Rows that repeat an id are rows of their own; equal rows are copies of
    each other and lose all words that a window covers. An empty table gives an empty result.
    """
    # A null id is a text of its own here, so that joins find it.
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    docs = text_batches(docs).select(name.alias("doc_id"), F.col(text_col).alias("text"))
    signed = checkpointed(_anchored(docs, span))
    spots = signed.select("doc_id", "of", F.posexplode("g").alias("j", "g"))
    repeated = checkpointed(spots.groupBy("g").count().filter("count > 1").select("g", (F.col("count") > OFTEN).alias("often")))
    found = Repeated.of(repeated, repeated.count(), most_anchors)
    rows = docs
    if found.bits is None:
        marks = spots.join(repeated, "g").groupBy("doc_id", "of").agg(F.collect_set(F.struct("j", "g", "often")).alias("marks"))
        rows = _told_apart(docs).join(checkpointed(marks), ["doc_id", "of"])
    contexts = checkpointed(_contexts(rows, found, span))
    counted = contexts.filter("doc_id is null").select("shard", "digest", "words", "n")
    counted = counted.repartition("shard").sortWithinPartitions("shard")
    judged = counted.mapInPandas(_judged(span), "shard bigint, digest binary, bits bigint")
    places = contexts.filter("doc_id is not null").select("doc_id", "sha", "at", "shard", "digest")
    hits = places.join(judged, ["shard", "digest"])
    hits = checkpointed(hits.groupBy("doc_id", "sha").agg(F.collect_set(F.struct("at", "bits")).alias("hits")))
    touched = _text_of(docs, hits.select(F.col("doc_id").alias("id"))).join(hits, "doc_id")
    cut = touched.mapInPandas(_cut(span, texts), "doc_id string, sha bigint, n_removed bigint, kept_sha256 string, kept string")
    what = ["n_removed", "kept_sha256", *(["kept"] if texts else [])]
    # Rows that repeat an id and a text are cut alike.
    cut = cut.groupBy("doc_id", "sha").agg(*(F.first(x).alias(x) for x in what))
    signed = signed.select("doc_id", "n_words", F.col("sha").alias("whole"), F.conv(F.substring("sha", 1, 16), 16, -10).cast("bigint").alias("sha"))
    out = signed.join(cut, ["doc_id", "sha"], "left")
    out = out.select(
        F.when(F.col("doc_id") != "-", F.col("doc_id")).cast("bigint").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        *(["kept"] if texts else []),
    )
    return out
