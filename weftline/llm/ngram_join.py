"""N-gram Jaccard join by T-occurrence search: its links and their components.

Two texts whose sets of word n-grams have Jaccard similarity of at least 0.8 share T = ceil(4/9 of the
sum of their sizes) n-grams. Which documents reach T is a T-occurrence problem over inverted lists.

1. Texts of equal words are one class, held by its smallest id.
2. N-grams are ordered, frequent ones last and else by hash. Two texts that reach T share an n-gram of
   their prefixes in this order, so that inverted lists are needed for prefixes only, and lists with one
   class go. Counts that find the frequent ones cover all texts; only the order depends on them.
3. Each list's members are searched from its smallest member, and links found join components. Members
   of a list that are still in different components are then searched pairwise, as far as sizes and bit
   signatures allow T. A group of near copies is so joined by a star, which gives its component.
4. Linked classes are in one component, so the links of a component are found inside it: its classes are
   dealt into blocks, each pair of blocks meets once, and every member is searched. Links are counted
   there (a class counts as often as it has rows) or written out as pairs of classes.
5. A search takes one query and at most CHUNK members. It builds the inverted lists of the members,
   merges the short ones and probes the few long ones for those members that can still reach T
   (DivideSkip). Members that reach it are links; the overlap is exact.

No link is lost: any two linked texts share a list, end in one component by step 3, and meet in step 4.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, sketch_of, text_batches, within
from weftline.llm.components import components
from weftline.llm.textcodes import ngram_hashes, word_hashes

N = 5
#: Members per search.
CHUNK = 256
#: An n-gram that texts of so many n-grams hold so often is reported; the table of frequent ones is bounded.
TOGETHER, REPORTED, MOST_FREQUENT = 3_000_000, 4, 100_000
#: N-grams of a block of a component.
BLOCK = 400_000
SIGNATURE_BITS = 1024
SKETCH_BITS, MOST_SKETCH_BITS = 1 << 20, 1 << 26


def ngram_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of a shorter text, of the whole sequence."""
    return np.unique(ngram_hashes(words, min(n, len(words)))) if len(words) else words


def _key(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _at_least(n: np.ndarray | int, part: int, whole: int):
    """ceil(part / whole * n) in integers."""
    return (n * part + whole - 1) // whole


def frequent_ngrams(docs: DataFrame, n: int = N) -> np.ndarray:
    """Hashes of the most frequent n-grams, most frequent first.

    Texts with TOGETHER n-grams in all report those that they hold REPORTED times; reports are added up.
    """

    def reported(sets: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
        often = counts >= REPORTED
        return pd.DataFrame({"h": values[often].view(np.int64), "n": counts[often]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, sets, size = set(), [], 0
        for batch in batches:
            for text in batch["text"]:
                words = word_hashes(text, lower=True)
                key = _key(words)
                if key not in seen:
                    seen.add(key)
                    sets.append(ngram_set(words, n))
                    size += len(sets[-1])
            if size > TOGETHER:
                yield reported(sets)
                seen, sets, size = set(), [], 0
        yield reported(sets)

    totals = docs.mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    return np.array([r["h"] for r in top], np.int64).view(np.uint64)


def _signed(docs: DataFrame, frequent: np.ndarray, n: int) -> DataFrame:
    """(doc_id, n_shingles, key, prefix, light, bits) of every text.

    ``prefix`` are the first n-grams in order, of which ``light`` are not in the table of frequent ones;
    ``bits`` has a bit for each residue that an odd number of
    n-grams has, so that two signatures differ in no more bits than the sets in n-grams.
    """
    order = np.argsort(frequent)
    values, ranks = frequent[order], (len(frequent) - np.arange(len(frequent)))[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys, prefixes, lights, bits = [], [], [], [], []
            for text in batch["text"]:
                words = word_hashes(text, lower=True)
                grams = ngram_set(words, n)
                keys.append(_key(words))
                sizes.append(len(grams))
                size = len(grams) - int(_at_least(len(grams), 4, 5)) + 1 if len(grams) else 0
                ordered, light = grams, len(grams)
                if len(values) and len(grams):
                    at = np.searchsorted(values, grams)
                    at[at == len(values)] = 0
                    often = values[at] == grams
                    if often.any():
                        light -= int(often.sum())
                        ordered = grams[np.argsort(np.where(often, ranks[at], 0), kind="stable")]
                lights.append(min(light, size))
                prefixes.append(ordered[:size].view(np.int64))
                odd = np.bincount((grams >> np.uint64(7)).astype(np.int64) & (SIGNATURE_BITS - 1), minlength=SIGNATURE_BITS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "key": keys, "prefix": prefixes, "light": lights, "bits": bits})

    schema = "doc_id string, n_shingles bigint, key binary, prefix array<bigint>, light int, bits array<bigint>"
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _may_link(n1: Column, bits1: Column, n2: Column, bits2: Column) -> Column:
    """Whether sizes and signatures leave room for similarity 0.8."""
    differ = sum((F.bit_count(bits1[k].bitwiseXOR(bits2[k])) for k in range(SIGNATURE_BITS // 64)), F.lit(0))
    # |x| + |y| - 2 T is the most that linked sets can differ in.
    most = n1 + n2 - 2 * F.ceil((n1 + n2) * 4 / 9)
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (differ <= most)


def _enough(n1: str, n2: str) -> Column:
    """Whether the n-grams that two prefixes share leave room for T.

    All shared n-grams up to the end of the prefix that ends first are in both prefixes; of the others
    that text has at most ceil(0.8 n) - 1.
    """
    both, most = F.col(n1) + F.col(n2), F.greatest(n1, n2)
    return F.col("shared") >= F.ceil(both * 4 / 9) - (F.ceil(most * 4 / 5) - 1)


def search(query: np.ndarray, members: list[np.ndarray], factor: float = 0.01) -> list[int]:
    """Places of the members whose similarity to the query is at least 0.8, by DivideSkip."""
    sizes = np.array([len(m) for m in members], np.int64)
    values = np.concatenate(members)
    holder = np.repeat(np.arange(len(members)), sizes)
    at = np.searchsorted(query, values)
    at[at == len(query)] = 0
    held = query[at] == values if len(query) else np.zeros(len(values), bool)
    lists, holder = at[held], holder[held]
    lengths = np.bincount(lists, minlength=len(query))
    need = _at_least(sizes + len(query), 4, 9)
    longest = int(lengths.max(initial=0))
    # With L long lists set aside, a member must stand in need - L of the short ones.
    n_long = min(int(need.min(initial=1) / (factor * math.log2(longest + 1) + 1)), int(need.min(initial=1)) - 1, len(query)) if longest else 0
    long = np.zeros(len(query), bool)
    if n_long > 0:
        long[np.argpartition(lengths, -n_long)[-n_long:]] = True
    counts = np.bincount(holder[~long[lists]], minlength=len(members))  # the merge of the short lists
    hopeful = np.flatnonzero(counts >= need - n_long)
    probes = query[long]
    out = []
    for m in hopeful.tolist():
        own = members[m]
        place = np.searchsorted(own, probes)
        place[place == len(own)] = 0
        overlap = int(counts[m]) + int((own[place] == probes).sum())
        if 100 * overlap >= 80 * (len(query) + len(own) - overlap):
            out.append(m)
    return out


def id_sketch(ids: DataFrame) -> np.ndarray:
    """A bit for each hash residue of the ids, only used to leave out others early. ``ids`` should be
    materialised: there are 16 bits an id, between SKETCH_BITS and MOST_SKETCH_BITS."""
    bits = min(MOST_SKETCH_BITS, max(SKETCH_BITS, 1 << (16 * ids.count()).bit_length()))
    bit = F.xxhash64("id").bitwiseAND(bits - 1)
    rows = ids.groupBy(F.floor(bit / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("x")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64)
    return out


def sketched(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes have their bit set."""
    bit = hashes & (64 * len(sketch) - 1)
    return (sketch[bit >> 6] >> (bit & 63)) & 1 == 1


def _sets(docs: DataFrame, ids: DataFrame, n: int, keyed: bool = False) -> DataFrame:
    """(id, grams) of the texts with the ids, and perhaps of some others; ``keyed``, also their keys."""
    sketch = id_sketch(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[sketched(sketch, batch["bit"].to_numpy(np.int64))]
            words = [word_hashes(t, lower=True) for t in batch["text"]]
            out = pd.DataFrame({"id": batch["id"], "grams": [ngram_set(w, n).tobytes() for w in words]})
            yield out.assign(key=[_key(w) for w in words]) if keyed else out

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("bit"))
    return rows.mapInPandas(run, "id bigint, grams binary" + ", key binary" * keyed)


def _searches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (q, chunk, m), the query itself first with a null m."""
    at, query, ids, members = None, [], [], []

    def run() -> pd.DataFrame:
        found = sorted({ids[k] for q in query for k in search(q, members)}) if members else []
        return pd.DataFrame({"a": np.full(len(found), at[0] if at else 0, np.int64), "b": np.array(found, np.int64)})

    for batch in batches:
        for q, chunk, m, grams in zip(batch["q"], batch["chunk"], batch["m"], batch["grams"], strict=True):
            if (q, chunk) != at:
                if members:
                    yield run()
                at, query, ids, members = (q, chunk), [], [], []
            if pd.isna(m):
                query.append(np.frombuffer(grams, np.uint64))
            else:
                ids.append(int(m))
                members.append(np.frombuffer(grams, np.uint64))
    if members:
        yield run()


def _verified(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The pairs (q, m) that link, by searches of one query and at most about CHUNK members."""
    many = pairs.groupBy("q").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    pairs = checkpointed(pairs.join(many, "q").select("q", "m", F.pmod(F.xxhash64("m"), F.col("chunks")).alias("chunk")))
    ids = checkpointed(pairs.select(F.explode(F.array("q", "m")).alias("id")).distinct())
    sets = checkpointed(_sets(docs, ids, n))
    rows = pairs.join(sets, pairs["m"] == sets["id"]).select("q", "chunk", "m", "grams")
    heads = pairs.select("q", "chunk").distinct().join(sets, F.col("q") == sets["id"])
    rows = rows.unionByName(heads.select("q", "chunk", F.lit(None).cast("bigint").alias("m"), "grams"))
    rows = rows.repartition("q", "chunk").sortWithinPartitions("q", "chunk", F.col("m").asc_nulls_first())
    return checkpointed(rows.mapInPandas(_searches, "a bigint, b bigint"))


def _lists(classes: DataFrame) -> DataFrame:
    """(h, rep, n, q): the inverted lists with more than one class, q being the smallest.

    Lists of n-grams outside the table of frequent ones are short and are sorted once. The others are
    reduced to their smallest class where their rows are, so that no task gathers a long list.
    """
    postings = classes.select("rep", "n", "light", F.posexplode("prefix").alias("at", "h"))
    postings = postings.select("h", "rep", "n", (F.col("at") < F.col("light")).alias("short"))
    own = W.partitionBy("h")
    short = postings.filter("short").select("h", "rep", "n")
    short = short.withColumns({"q": F.min("rep").over(own), "other": F.max("rep").over(own)}).filter("q < other").drop("other")
    long = postings.filter("not short").select("h", "rep", "n")
    heads = long.groupBy("h").agg(F.min("rep").alias("q"), F.max("rep").alias("other")).filter("q < other").drop("other")
    return short.unionByName(long.join(heads, "h")).select("h", "rep", "n", "q")


def _grouped(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (key, rep, copies, component_id) of each class of equal words."""
    signed = checkpointed(_signed(docs, frequent_ngrams(docs, n), n))
    some = signed.filter("n_shingles > 0")
    held = checkpointed(some.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = held.filter("rep is not null").select(F.col("rep").alias("doc_id"), "key")
    classes = some.join(first, ["doc_id", "key"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "prefix", "light", "bits")
    live = checkpointed(_lists(classes))
    facts = some.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bits")
    facts = checkpointed(facts.join(live.select("rep").distinct(), "rep", "left_semi"))
    of = lambda side: facts.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    # A link that this count misses, as other lists of the pair have another smallest member, is found below.
    first = live.filter("rep <> q").groupBy("q", F.col("rep").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
    first = first.join(of("q"), "q").join(of("m"), "m").filter(_enough("n_q", "n_m"))
    first = first.filter(_may_link(F.col("n_q"), F.col("bits_q"), F.col("n_m"), F.col("bits_m"))).select("q", "m").distinct()
    links = _verified(docs, first, n)
    found = checkpointed(components(links))
    # Lists that still hold more than one component.
    placed = live.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    open_ = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("h")
    rest = checkpointed(placed.join(open_, "h").join(facts.select("rep", "bits"), "rep").select("h", "rep", "n", "bits", "c"))
    a, b = rest.alias("a"), rest.alias("b")
    c = F.col
    apart = (c("a.h") == c("b.h")) & (c("a.rep") < c("b.rep")) & (c("a.c") != c("b.c"))
    second = a.join(b, apart & _may_link(c("a.n"), c("a.bits"), c("b.n"), c("b.bits")))
    second = second.groupBy(c("a.rep").alias("q"), c("b.rep").alias("m"), c("a.n").alias("n_q"), c("b.n").alias("n_m")).agg(F.count(F.lit(1)).alias("shared"))
    second = second.filter(_enough("n_q", "n_m")).select("q", "m").distinct()
    more = _verified(docs, second, n)
    linked = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = components(linked).withColumnRenamed("node", "rep")
    return signed, held.join(final, "rep", "left").withColumn("component_id", F.coalesce("component", "rep")).drop("component")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def _placed(signed: DataFrame, by_key: DataFrame) -> DataFrame:
    """The rows of ``signed`` with what is known of their class; blank texts have no class."""
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(by_key, "key", "left").withColumn("component_id", own)


def _met(pairs: bool):
    """Rows sorted by (component, i, j): the members of two blocks, or of one block where i = j."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}

        def links() -> pd.DataFrame:
            _, i, j = at
            keys = list(held)
            blocks, copies, sets = zip(*held.values(), strict=True)
            sizes, block, weight = np.array([len(x) for x in sets]), np.array(blocks), np.array(copies)
            total, out = np.zeros(len(keys), np.int64), []
            for q in np.flatnonzero(block == i).tolist():
                other = (block == j) & (5 * np.minimum(sizes, sizes[q]) >= 4 * np.maximum(sizes, sizes[q]))
                if i == j:
                    other[: q + 1] = False
                other = np.flatnonzero(other)
                if len(other):
                    found = other[search(sets[q], [sets[m] for m in other.tolist()])]
                    total[found] += weight[q]
                    total[q] += weight[found].sum()
                    if pairs:
                        out += [(min(keys[q], keys[m]), max(keys[q], keys[m])) for m in found.tolist()]
            if pairs:
                return pd.DataFrame(out, columns=["a", "b"])
            some = np.flatnonzero(total).tolist()
            return pd.DataFrame({"key": [keys[m] for m in some], "n": total[some]})

        for batch in batches:
            for component, i, j, block, key, copies, grams in batch.itertuples(index=False):
                if (component, i, j) != at:
                    if held:
                        yield links()
                    at, held = (component, i, j), {}
                held[key] = block, copies, np.frombuffer(grams, np.uint64)  # equal rows of an id come once
        if held:
            yield links()

    return run


def _links(docs: DataFrame, signed: DataFrame, by_key: DataFrame, n: int, pairs: bool = False) -> DataFrame:
    """Of each class with links (key, n): the rows of the classes that it links with; or all ``pairs`` (a, b) of keys."""
    size = signed.select("key", "n_shingles").groupBy("key").agg(F.first("n_shingles").alias("size"))
    members = by_key.filter("rep is not null")
    several = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").drop("classes")
    members = checkpointed(members.join(several, "component_id").join(size, "key"))
    blocks = members.groupBy("component_id").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    members = members.join(blocks, "component_id").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    sets = _sets(docs, members.select(F.col("rep").alias("id")), n, keyed=True).withColumnRenamed("id", "rep")
    met = members.join(sets, ["rep", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("component_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "grams")
    met = met.repartition("component_id", "i", "j").sortWithinPartitions("component_id", "i", "j")
    if pairs:
        return met.mapInPandas(_met(True), "a binary, b binary")
    return met.mapInPandas(_met(False), "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    ``n_links`` is the number of other rows whose text has similarity 0.8 or more, copies included.
    Texts of fewer than n words have their whole sequence as one n-gram; null and blank texts have none
    and link with nothing. A row with a null id takes part through rows of equal text that have one;
    else it is alone, its component_id is null and it has no links. Rows that repeat an id are one
    document with several texts. An empty table gives an empty result.
    """
    docs = _texts(docs, id_col, text_col)
    signed, by_key = _grouped(docs, n)
    by_key = checkpointed(by_key)
    counted = by_key.join(_links(docs, signed, by_key, n), "key", "left")
    counted = counted.select("key", "component_id", F.when(F.col("rep").isNotNull(), F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    return _placed(signed, counted).select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N) -> tuple[DataFrame, DataFrame]:
    """The join itself: (class_a, class_b) of all linked classes of equal words, and (doc_id, class) of every row.

    Each pair comes once, the smaller class first. Rows of one class link with each other. Blank texts
    have no class; classes of rows without an id link with none.
    """
    docs = _texts(docs, id_col, text_col)
    signed, by_key = _grouped(docs, n)
    by_key = checkpointed(by_key)
    pairs = _links(docs, signed, by_key, n, pairs=True)
    members = signed.select("doc_id", F.when(F.col("n_shingles") > 0, F.lower(F.hex("key"))).alias("class"))
    return pairs.select(F.lower(F.hex("a")).alias("class_a"), F.lower(F.hex("b")).alias("class_b")), members


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold their component, with all their columns. Rows without an id stay.

    Rows that repeat an id stay or go together. An empty table gives an empty result.
    """
    placed = _placed(*_grouped(_texts(docs, id_col, text_col), N))
    gone = checkpointed(placed.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    own = F.col(id_col).cast("bigint")
    # Rows that the sketch tells apart from all dropped ones stay without being shuffled.
    touched = F.coalesce(within(F.xxhash64(own), sketch_of(gone, F.xxhash64("gone"))), F.lit(False))
    some = docs.filter(touched).select(F.struct("*").alias("row"), own.alias("own")).join(gone, F.col("own") == F.col("gone"), "left_anti")
    return docs.filter(~touched).unionByName(some.select("row.*"))
