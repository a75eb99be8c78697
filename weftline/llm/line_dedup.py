"""Line deduplication by an exact set-similarity join.

A line is removed if an earlier line of the corpus (by document, then by place) has word sets of Jaccard
similarity of at least 0.8; lines are judged on the input, not on what is left.

1. Lines of equal text are one class, held by its earliest line. Later lines are left out by sketches of places;
   one that slips through matches the first line of its class and changes nothing.
2. Words are ordered by rarity. Counts of all words go into a table of BUCKETS numbers, whatever the size
   of the vocabulary; words of one bucket share a rank and are ordered by hash. Any fixed order gives
   the same result, a rarer-first order just gives short lists.
3. Two similar lines share a word of their prefixes in this order. A posting is a prefix word with the
   line's size, the word's position in it and bit signatures of the line.
4. First round: in the lists of the words in the first ninth of each line, a line is held against the list's
   first line and the one before it, so that a group of any size costs two pairs a posting. One earlier match
   settles a line.
5. Second round: the lists of all prefix words are joined for lines that are not settled, under the positional
   filter (their first shared word leaves room for the overlap only if it stands early enough in both, which
   includes the length filter) and the signatures. No pair that could match is left out, so no match is lost.
6. Jaccard is verified on the words themselves in both rounds.

All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, WORD_GAP, checkpointed, one_bit, sketch_of, within

BUCKETS = 1 << 16
#: Ranks are logarithms of counts to the base 2, times this. Numbers up to 127 are quick to look up.
STEPS = 4
#: A list that may have more postings than this, and than four times the mean, is dealt to several tasks
#: in the first round.
PER_TASK = 1 << 14
#: Lines of up to so many words have a signature of one number, or of two; others of four.
ONE, TWO = 64, 200
_LAST = (1 << 63) - 1
#: Marks the positions of settled lines.
_SETTLED = 1 << 30
_SIGNATURE = ("s0", "s1", "s2", "s3")
_ENTRY = ("doc", "at", "pos", *_SIGNATURE)


def _worded(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def _whole(docs: DataFrame) -> DataFrame:
    """(doc, sha, keys): of each text the places and keys of its lines with a word."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("ln"), x.alias("line")))
    keys = F.transform(
        F.filter(split, lambda x: _worded(x["line"])),
        lambda x: F.struct(x["ln"].alias("ln"), F.xxhash64(x["line"]).alias("k1"), F.xxhash64(F.lit("#"), x["line"]).alias("k2")),
    )
    return docs.select("doc", F.sha2("text", 256).alias("sha"), keys.alias("keys"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, ln, line) of the lines with a word."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("ln", "line")).filter(_worded(F.col("line")))


def _words(line: Column) -> Column:
    """The words of a line; few lines have other separators than spaces, and a split at a pattern is slow."""
    split = F.when(F.rlike(line, F.lit(r"[\x09-\x0D]")), F.split(line, WORD_GAP)).otherwise(F.split(line, " "))
    return F.array_remove(split, "")


def _ranks(lines: DataFrame) -> list[int]:
    """For each bucket, STEPS times the logarithm of the count of its words; BUCKETS numbers."""
    words = lines.select(F.explode(_words(F.col("line"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for row in counts.select("b", F.floor(STEPS * F.log2(F.col("n") + 1)).cast("int").alias("rank")).toLocalIterator():
        out[row["b"]] = row["rank"]
    return out


def _firsts(whole: DataFrame) -> DataFrame:
    """(k1, k2, doc, ln, held): of each class the earliest place and the number of places."""
    keyed = whole.select("doc", F.explode("keys").alias("x")).select("doc", "x.*")
    firsts = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc", "ln")).alias("first"), F.count(F.lit(1)).alias("held"))
    return checkpointed(firsts.select("k1", "k2", "first.doc", "first.ln", "held"))


def _first_lines(lines: DataFrame, whole: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines without those whose text an earlier line has; few of these stay."""
    place = F.xxhash64("doc", "ln")
    keyed = whole.select("doc", F.explode("keys").alias("x")).select("doc", "x.*")
    several = firsts.filter("held > 1")
    again = keyed.filter(within(F.col("k1"), sketch_of(several, F.col("k1")))).join(several.select("k1", "k2", F.struct("doc", "ln").alias("first")), ["k1", "k2"])
    later = within(place, sketch_of(checkpointed(again.filter(F.col("first") < F.struct("doc", "ln")).select("doc", "ln")), place))
    both = checkpointed(firsts.filter(later).select("doc", "ln"))
    # Another hash: keys that share a bit in one sketch should not share one in the next.
    other = F.xxhash64("ln", "doc")
    return lines.filter(~later | within(other, sketch_of(both, other)))


def _classes(lines: DataFrame, ranks: list[int]) -> DataFrame:
    """(doc, ln, n, s0 .. s3, prefix) of each line."""
    # A literal: as a subquery the table would be copied into every row.
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")
    none = F.lit(0).cast("long")
    code = lambda h: F.shiftleft(F.coalesce(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), none), 50).bitwiseOR(F.shiftrightunsigned(h, 14))
    coded = lines.select("doc", "ln", F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))).alias("h"))
    coded = coded.select("doc", "ln", F.sort_array(F.transform("h", code)).alias("v"))
    n = F.size("v")
    # Bits of the words that have all bits of ``of``; without them, of all words.
    signed = lambda *of: F.aggregate("v", none, lambda a, x: a.bitwiseXOR(_bit_if(x, of)))
    coded = coded.select("doc", "ln", n.alias("n"), signed().alias("x"), F.when(n > ONE, signed(13)).alias("x1"), F.when(n > TWO, signed(12)).alias("x2"), F.when(n > TWO, signed(12, 13)).alias("x3"), "v")
    # Parts that do not overlap, from those that do.
    x, x1, x2, x3 = (F.col(k) for k in ("x", "x1", "x2", "x3"))
    return coded.select(
        "doc",
        "ln",
        "n",
        F.when(n <= ONE, x).when(n <= TWO, x.bitwiseXOR(x1)).otherwise(x.bitwiseXOR(x1).bitwiseXOR(x2).bitwiseXOR(x3)).alias("s0"),
        F.when(n <= TWO, none).otherwise(x2.bitwiseXOR(x3)).alias("s1"),
        F.when(n <= ONE, none).when(n <= TWO, x1).otherwise(x1.bitwiseXOR(x3)).alias("s2"),
        F.when(n <= TWO, none).otherwise(x3).alias("s3"),
        F.slice("v", 1, n - F.ceil(n * 4 / 5).cast("int") + 1).alias("prefix"),
    )


def _bit_if(x: Column, of: tuple[int, ...]) -> Column:
    """The long with the bit that the last six bits of x name, or 0 where x lacks one of the bits ``of``."""
    one = F.lit(1).cast("long")
    for k in of:
        one = F.shiftright(x, k).bitwiseAND(one)
    return F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))


def _at() -> Column:
    return F.shiftleft(F.col("ln").cast("long"), 32).bitwiseOR(F.col("n").cast("long")).alias("at")


def _postings(classes: DataFrame, *more: str) -> DataFrame:
    """(pos, t, doc, at, s0 .. s3): a word of a line's prefix; ``at`` holds the line's place and its size."""
    return classes.select(F.posexplode("prefix").alias("pos", "t"), "doc", _at(), *_SIGNATURE, *more)


def _size(a: str) -> Column:
    return F.col(f"{a}.at").bitwiseAND((1 << 32) - 1)


def _near(a: str, b: str) -> Column:
    """Whether the signatures leave room for similarity 0.8: such sets differ in a ninth of the sum of their sizes at most.

    Sets differ in no more words than signatures in bits; a signature of several numbers is folded where
    the other has fewer.
    """
    n, m = _size(a), _size(b)
    x = [F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")) for s in _SIGNATURE]
    low, high = x[0].bitwiseXOR(x[1]), x[2].bitwiseXOR(x[3])
    least = F.least(n, m)
    differ = F.when(least <= ONE, F.bit_count(low.bitwiseXOR(high))).when(least <= TWO, F.bit_count(low) + F.bit_count(high)).otherwise(sum((F.bit_count(y) for y in x), F.lit(0)))
    return 9 * differ <= n + m


def _early(a: str, i: Column, b: str, j: Column) -> Column:
    """Whether the first word that two lines share, at ``i`` and ``j``, leaves room for the overlap.

    Similar sets share 4/9 of the sum of their sizes at least. With i and j 0 this is the length filter.
    """
    n, m = _size(a), _size(b)
    return 9 * F.least(n - i, m - j) >= 4 * (n + m)


def _ids(pairs: DataFrame) -> DataFrame:
    """From (a, b) to the distinct (doc, ln, doc2, ln2)."""
    ln = lambda x: F.shiftright(f"{x}.at", 32).cast("int")
    return checkpointed(pairs.select(F.col("a.doc").alias("doc"), ln("a").alias("ln"), F.col("b.doc").alias("doc2"), ln("b").alias("ln2")).distinct())


def _in_ninth(pos: Column) -> Column:
    return 9 * pos <= F.col("at").bitwiseAND((1 << 32) - 1)


def _first_pairs(classes: DataFrame, ranks: list[int]) -> DataFrame:
    """Each line of a list with the list's first line and with the one before it, where they may match."""
    counts = [2 ** ((r + 1) / STEPS) for r in ranks]
    most = max(PER_TASK, 4 * sum(counts) / BUCKETS)
    # The bucket's count bounds the list.
    part = F.pmod(F.xxhash64("doc", "at"), F.ceil(F.pow(F.lit(2.0), (F.shiftright("t", 50) + 1) / STEPS) / most))
    rows = _postings(classes).filter(_in_ninth(F.col("pos"))).withColumn("part", part)
    rows = rows.repartition("t", "part").select("t", "part", F.struct(*_ENTRY).alias("a"))
    own = W.partitionBy("t", "part").orderBy("a.doc", "a.at")
    rows = rows.select("a", F.first("a").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("head"), F.lag("a").over(own).alias("last"))
    rows = rows.filter("last is not null").select("a", F.explode(F.array_distinct(F.array("head", "last"))).alias("b"))
    earlier = F.struct("b.doc", "b.at") < F.struct("a.doc", "a.at")  # rows that repeat an id may hold a line twice
    return _ids(rows.filter(_early("a", F.col("a.pos"), "b", F.col("b.pos")) & earlier & _near("a", "b")))


def _other_pairs(classes: DataFrame, settled: DataFrame) -> DataFrame:
    """All pairs that may match of a line that is not settled and an earlier one."""
    mark = within(F.xxhash64("doc", "ln"), sketch_of(settled, F.xxhash64("doc", "ln")))
    some = classes.filter(mark).join(settled.withColumn("s", F.lit(True)), ["doc", "ln"], "left")
    classes = classes.filter(~mark).withColumn("s", F.lit(False)).unionByName(some.withColumn("s", F.coalesce("s", F.lit(False))))
    rows = _postings(classes, "s").withColumn("pos", F.col("pos").bitwiseOR(F.when(F.col("s"), _SETTLED).otherwise(0))).drop("s")
    # Of two similar lines, the first word that they share stands in the first ninth of the one that is no
    # longer. Lists are joined with these words only; one of very many lines is split where the join is skewed.
    place = lambda x: F.col(x).bitwiseAND(_SETTLED - 1)
    n, m = _size("a"), _size("b")
    before = (F.col("b.doc") < F.col("a.doc")) | ((F.col("b.doc") == F.col("a.doc")) & (F.col("b.at") < F.col("a.at")))
    asks = F.when(before, F.col("a.pos")).otherwise(F.col("b.pos")) < _SETTLED
    match = (F.col("a.t") == F.col("b.t")) & (m <= n) & _early("a", place("a.pos"), "b", place("b.pos")) & ((m < n) | before) & asks & _near("a", "b")
    sides = (
        F.when(before, F.struct("a.doc", "a.at")).otherwise(F.struct("b.doc", "b.at")).alias("a"),
        F.when(before, F.struct("b.doc", "b.at")).otherwise(F.struct("a.doc", "a.at")).alias("b"),
    )
    # In halves, by the words' hashes: the files of one half go before the other is shuffled.
    halves = []
    for half in (0, 1):
        long = rows.filter(F.col("t").bitwiseAND(1) == half)
        short = long.filter(_in_ninth(place("pos")))
        halves.append(_ids(long.alias("a").join(short.alias("b"), match).select(*sides)))
    return checkpointed(halves[0].unionByName(halves[1]).distinct())


def _matches(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, ln) of the lines with a pair that has Jaccard 0.8 on the words themselves."""
    ids = pairs.select(F.explode(F.array(F.struct("doc", "ln"), F.struct(F.col("doc2").alias("doc"), F.col("ln2").alias("ln")))).alias("p")).select("p.*").distinct()
    ids = checkpointed(ids)
    held = docs.filter(within(F.xxhash64("doc"), sketch_of(ids, F.xxhash64("doc"))))
    texts = _lines(held).filter(within(F.xxhash64("doc", "ln"), sketch_of(ids, F.xxhash64("doc", "ln")))).join(ids, ["doc", "ln"], "left_semi")
    texts = checkpointed(texts.groupBy("doc", "ln").agg(F.array_distinct(_words(F.first("line"))).alias("x")))
    other = texts.select(F.col("doc").alias("doc2"), F.col("ln").alias("ln2"), F.col("x").alias("y"))
    both = pairs.join(texts, ["doc", "ln"]).join(other, ["doc2", "ln2"])
    shared = F.size(F.array_intersect("x", "y"))
    return checkpointed(both.filter(10 * shared >= 8 * (F.size("x") + F.size("y") - shared)).select("doc", "ln").distinct())


def _late_lines(docs: DataFrame, classes: DataFrame, ranks: list[int]) -> DataFrame:
    """(doc, ln) of the distinct lines, at their first place, that an earlier line matches."""
    settled = _matches(docs, _first_pairs(classes, ranks))
    return settled.unionByName(_matches(docs, _other_pairs(classes, settled)))


def _to_remove(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """(doc, lns): the places of the lines to remove, of documents that have any."""
    firsts = _firsts(whole)
    lines = _first_lines(_lines(docs), whole, firsts)
    ranks = _ranks(lines)
    late = _late_lines(docs, checkpointed(_classes(lines, ranks)), ranks).withColumn("late", F.lit(True))
    late = checkpointed(late)
    # A class matters if it goes as a whole, or if it has lines after its first.
    some = firsts.filter((F.col("held") > 1) | within(F.xxhash64("doc", "ln"), sketch_of(late, F.xxhash64("doc", "ln"))))
    some = some.join(late, ["doc", "ln"], "left").filter("late or held > 1")
    some = checkpointed(some.select("k1", "k2", F.struct("doc", "ln").alias("first"), F.coalesce("late", F.lit(False)).alias("late")))
    keyed = whole.select("doc", F.explode("keys").alias("x")).select("doc", "x.*").filter(within(F.col("k1"), sketch_of(some, F.col("k1"))))
    gone = keyed.join(some, ["k1", "k2"]).filter(F.col("late") | (F.col("first") < F.struct("doc", "ln")))
    return checkpointed(gone.groupBy("doc").agg(F.sort_array(F.collect_set("ln")).alias("lns")))


def cut_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_lines (with a word), n_removed, kept_sha256 (with ``texts``, also
    the kept text, null where nothing goes).

    Null and empty texts have no lines and stay as they are. Rows with a null id come last and rows that
    repeat an id are one document; where their texts differ, a line goes from all of them if it goes at
    its place in one. Lines without words stay. An empty table gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blank = lambda x: F.length(F.btrim(x, F.lit(SPACES))) == 0
    whole = checkpointed(_whole(docs))
    gone = _to_remove(docs, whole)
    touched = docs.filter(within(F.xxhash64("doc"), sketch_of(gone, F.xxhash64("doc")))).join(gone, "doc")
    stays = F.filter(F.split("text", "\n"), lambda x, i: blank(x) | ~F.array_contains("lns", i))
    goes = F.filter(F.split("text", "\n"), lambda x, i: ~blank(x) & F.array_contains("lns", i))
    touched = touched.select("doc", F.sha2("text", 256).alias("sha"), F.size(goes).cast("long").alias("n_removed"), F.array_join(stays, "\n").alias("kept"))
    touched = touched.select(F.col("doc").alias("d"), F.col("sha").alias("s"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"), *(["kept"] if texts else []))
    what = touched.columns[2:]
    touched = touched.groupBy("d", "s").agg(*(F.first(x).alias(x) for x in what))
    out = whole.join(touched, (F.col("doc") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    return out.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        F.size("keys").cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *(["kept"] if texts else []),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS ln, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM d, unnest(range(1, len(ls) + 1)) u(i)),
c AS (SELECT line, min((doc_id, ln)) AS first, list_distinct(string_split_regex(line, '[\x20\x09-\x0D]+')) AS w FROM l WHERE line <> '' GROUP BY line),
k AS (SELECT *, row_number() OVER (ORDER BY first) AS id, len(w) AS n FROM c),
f AS (SELECT t, count(*) AS df FROM (SELECT unnest(w) AS t FROM k) GROUP BY t),
p AS (SELECT id, n, t FROM (
  SELECT id, n, t, row_number() OVER (PARTITION BY id ORDER BY df, t) AS r FROM (SELECT id, n, unnest(w) AS t FROM k) JOIN f USING (t))
  WHERE r <= n - ceil(n * 0.8 - 1e-9) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.t = b.t AND b.id < a.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
v AS (SELECT q.a, len(list_intersect(x.w, y.w)) AS s, x.n AS nx, y.n AS ny FROM q JOIN k x ON x.id = q.a JOIN k y ON y.id = q.b),
late AS (SELECT DISTINCT a AS id FROM v WHERE 10 * s >= 8 * (nx + ny - s)),
g AS (SELECT l.doc_id, l.ln FROM l JOIN k USING (line) LEFT JOIN late USING (id) WHERE late.id IS NOT NULL OR k.first <> (l.doc_id, l.ln)),
h AS (SELECT doc_id, list(ln) AS lns FROM g GROUP BY doc_id)
SELECT d.doc_id, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''))::BIGINT AS n_lines,
       coalesce(len(lns), 0)::BIGINT AS n_removed,
       sha256(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT coalesce(list_contains(lns, i - 1), false)], chr(10))) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""
