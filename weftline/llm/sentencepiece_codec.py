"""SentencePiece BPE encoding and decoding with a prefix table.

BPE is replaced by a left-to-right table. For each prefix of a text there is exactly one token that its
encoding ends with. Candidates are the vocabulary entries that end at the position, found by an
Aho-Corasick automaton; the right one is the one that is compatible with the last token of the prefix
before it, and following these last tokens backwards gives the ids. Two tokens are compatible if BPE
would leave them side by side: no part of the first that touches the boundary while BPE builds it would
merge with such a part of the second before both are used up.

A piece never holds a space mark behind another character, so texts are cut before runs of space marks.
Likewise no piece crosses two characters that stand side by side in no piece, so units are cut there
too, and each worker remembers what it has encoded. Runs of two or more marks, whose pieces tie in
score, and pieces that break the order which the compatibility test relies on, are merged step by step
instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import text_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of a generation of a worker's memory, and the longest unit in it.
REMEMBERED, LONGEST = 150_000, 48


class Memory:
    """A dictionary of bounded size: of two generations the older one goes when the younger is full."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encodes and decodes like the library, with an end id only and no sampling."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model without normalisation and with a dummy prefix is needed")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark inside")
        self.score = {p: model.pieces[i].score for p, i in self.ids.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.bytes = {
            str(i): bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode()
            for i, p in enumerate(model.pieces)
        }
        self.chars = {p for p in self.ids if len(p) == 1}
        gap = "" if any("\n" in p for p in self.ids) else "\n"
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Marks of punctuation stand in no piece behind another character, so units are cut before them.
        marks = {"."}
        while more := {b[0] for b in self.beside if b[1] in marks and b[0] != MARK} - marks:
            marks |= more
        own = "".join(map(re.escape, sorted(marks)))
        self.unit = re.compile(f"{MARK}*[^{MARK}{gap}{own}]+|{MARK}*[{own}]+[^{MARK}{gap}{own}]*|{MARK}+" + "|\n+" * bool(gap))
        self._spines()
        self.forget()

    def forget(self) -> None:
        self.fits, self.parts, self.units = Memory(2 * REMEMBERED), Memory(), Memory()

    # What BPE builds on the way to a piece.

    def _merged(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """BPE step by step: the pieces, and the halves that each merge joined."""
        n = len(text)
        part: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str]] = []
        halves: dict[str, tuple[str, str]] = {}

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (both := part[i] + part[j]) in self.score:
                heapq.heappush(agenda, (-self.score[both], i, both))

        for i in range(n):
            offer(i)
        while agenda:
            _, i, both = heapq.heappop(agenda)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != both:
                continue
            halves[both] = part[i], part[j]
            part[i], part[j], right[i] = both, None, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in part if p is not None], halves

    def _spines(self) -> None:
        """For each piece, what touches its left and its right edge while it is built.

        Entries are (part, score of what the part goes into); the piece itself goes into nothing.
        ``whole`` has the pieces that BPE makes of their own text, each from halves with better scores.
        """
        never = float("-inf")
        self.left_edge: dict[str, list[tuple[str, float]]] = {}
        self.right_edge: dict[str, list[tuple[str, float]]] = {}
        self.whole = set()
        for piece in self.ids:
            parts, halves = self._merged(piece)
            lefts, rights = [(piece, never)], [(piece, never)]
            ordered = parts == [piece]
            for edge, k in ((lefts, 0), (rights, 1)):
                at = piece
                while ordered and at in halves:
                    inner = halves[at][k]
                    ordered &= len(inner) == 1 or self.score[inner] > self.score[at]
                    edge.append((inner, self.score[at]))
                    at = inner
            if ordered:
                self.whole.add(piece)
                self.left_edge[piece], self.right_edge[piece] = lefts, rights
        self.automaton = ahocorasick.Automaton()
        for piece in self.whole:
            self.automaton.add_word(piece, (len(piece), self.ids[piece], piece))
        self.automaton.make_automaton()

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE leaves the pieces ``a`` and ``b`` side by side."""
        score = self.score
        for x, x_used in self.right_edge[a]:
            for y, y_used in self.left_edge[b]:
                joined = score.get(x + y)
                # On a tie the merge further left comes first: x's own before it, y's own after it.
                if joined is not None and joined > x_used and joined >= y_used:
                    return False
        return True

    def _table(self, text: str) -> list[int] | None:
        """The ids of a text of known characters, by the prefix table."""
        last: list[tuple[int, int, str] | None] = [None] * len(text)
        for end, found in self.automaton.iter(text):
            if last[end] is not None:
                continue
            before = end - found[0]
            if before < 0:
                last[end] = found
                continue
            ahead = last[before]
            if ahead is None:
                continue
            pair = ahead[1] << 32 | found[1]
            ok = self.fits.get(pair)
            if ok is None:
                self.fits.put(pair, ok := self.compatible(ahead[2], found[2]))
            if ok:
                last[end] = found
        out, at = [], len(text) - 1
        while at >= 0:
            if last[at] is None:
                return None
            n, token, _ = last[at]
            out.append(token)
            at -= n
        return out[::-1]

    def _part(self, part: str) -> str:
        if part[0] not in self.chars:
            return " ".join(str(self.byte[b]) for b in part.encode("utf-8"))
        found = None if part.startswith(MARK * 2) else self._table(part)
        return " ".join(map(str, [self.ids[p] for p in self._merged(part)[0]] if found is None else found))

    def _unit(self, unit: str) -> str:
        beside, start, out = self.beside, 0, []
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in beside:
                part = unit[start:i]
                start = i
                coded = self.parts.get(part)
                if coded is None:
                    coded = self._part(part)
                    if len(part) <= LONGEST:
                        self.parts.put(part, coded)
                out.append(coded)
        return " ".join(out)

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by one space, the end id last."""
        if not text:
            return str(self.end)
        young, out = self.units.young, []
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            coded = young.get(unit)
            if coded is None:
                coded = self.units.get(unit)
                if coded is None:
                    coded = self._unit(unit)
                    if len(unit) <= LONGEST:
                        self.units.put(unit, coded)
                young = self.units.young
            out.append(coded)
        out.append(str(self.end))
        return " ".join(out)

    def decode(self, ids: str) -> str:
        """The text of decimal ids; the space of the dummy prefix goes."""
        raw = b"".join(map(self.bytes.__getitem__, ids.split(" ")))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "doc_id bigint, ids string, decoded string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _coded(docs: DataFrame, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, ids, decoded): decimal ids joined by one space, and the text that they decode to."""
    path = path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(text) for text in batch["text"]]
            frame = pd.DataFrame({"doc_id": [None if pd.isna(x) else int(x) for x in batch["doc_id"]], "ids": ids, "decoded": [c.decode(x) for x in ids]})
            yield frame.astype({"doc_id": "Int64"})
        # The worker may go on to other stages.
        c.forget()

    return text_batches(docs, 1000).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>, the end id last), decoded.

    A null text is an empty one, whose only id is the end id. Rows are independent, so ties and
    repeated rows need no rule. An empty table gives an empty result. ``path`` names the model file,
    which every node must have.
    """
    return _coded(docs, path, id_col, text_col).select("doc_id", F.split("ids", " ").cast("array<int>").alias("ids"), "decoded")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what ``encode`` gives: doc_id, n_tokens, ids_sha256 (of the ids joined by one space), decoded_sha256."""
    n = (F.length("ids") - F.length(F.replace(F.col("ids"), F.lit(" "), F.lit(""))) + 1).cast("long")
    return _coded(docs, path, id_col, text_col).select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
