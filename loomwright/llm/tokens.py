"""Operator 9: token counts by heap-and-linked-list byte-pair merging.

A text becomes a linked list of characters; a heap gives the adjacent pair of the best-ranked piece
(the leftmost of equals), the pair is merged, and its two new neighbour pairs enter the heap, until no
pair is a piece. The count is the number of symbols at the start minus the merges, where a character
outside the vocabulary counts as its UTF-8 bytes. No identifier is looked up or emitted.

Only pieces of nothing but word marks hold a mark after their first character, so no merge crosses from
a word into the mark of the next: a text splits exactly into runs of marks with the word behind them,
and no merge joins two characters that are neighbours in no piece: runs split there, too. Each distinct
part is merged once per worker (a bounded memo). The word split is checked against the vocabulary when
it is loaded; a vocabulary without that property is merged text by text.

Defined results: null counts as empty; empty texts have no tokens; repeated rows are counted each; an
empty table gives an empty result; only doc_id and text are read. Texts are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
MEMO = 500_000
_PIECE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merger:
    """Counts tokens as a byte-fallback BPE model without text normalisation does."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "a  b\tc\n 　ﬁ é "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this operator wants a model that doesn't normalise texts, with a leading word mark")
        if not all(sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("this operator wants a model with byte fallback")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [(sp.id_to_piece(i), -sp.get_score(i)) for i in ids]
        order = {score: i for i, score in enumerate(sorted({score for _, score in pieces}))}
        self.rank = {piece: order[score] for piece, score in pieces}
        self.split = all(MARK not in p[1:] or not p.strip(MARK) for p in self.rank)
        self.chars = {p for p in self.rank if len(p) == 1}
        self.meets = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.free = not any("\n" in x for x in self.meets)
        self.memo: dict[str, int] = {}  # by part
        self.words: dict[str, int] = {}  # by word, its mark left out

    def merge(self, run: str) -> int:
        """Tokens of a string, merged on its own."""
        get = self.rank.get
        symbols: list[str | None] = list(run)
        size = n = len(symbols)
        if not self.chars.issuperset(symbols):
            n += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in symbols if c not in self.rank)
        shift = size.bit_length()  # a heap entry is rank << shift | place of the left symbol
        heap = []
        for i in range(size - 1):
            if (r := get(run[i : i + 2])) is not None:
                heap.append(r << shift | i)
        if not heap:
            return n
        low = (1 << shift) - 1
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        symbols.append(None)
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            a, j = symbols[i], right[i]
            if a is None or j >= size:
                continue  # merged away since
            pair = a + symbols[j]
            if get(pair) != entry >> shift:
                continue  # a part was merged since
            symbols[i], symbols[j] = pair, None
            n -= 1
            right[i] = k = right[j]
            if k < size:
                left[k] = i
                if (r := get(pair + symbols[k])) is not None:
                    heappush(heap, r << shift | i)
            h = left[i]
            if h >= 0 and (r := get(symbols[h] + pair)) is not None:
                heappush(heap, r << shift | h)
        return n

    def part(self, part: str) -> int:
        n = self.memo.get(part)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = self.merge(part)
            if len(part) <= 64:
                self.memo[part] = n
        return n

    def run(self, run: str) -> int:
        """Tokens of a run: cut where no piece could join two characters, and merged part by part."""
        meets = self.meets
        if run[1:-1].isalpha():  # a word and perhaps a stop: one place to cut is enough
            return self.part(run) if run[-2:] in meets else self.part(run[:-1]) + self.part(run[-1])
        total = begin = 0
        for i in range(1, len(run)):
            if run[i - 1 : i + 1] not in meets:
                total += self.part(run[begin:i])
                begin = i
        return total + self.part(run[begin:] if begin else run)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.split and self.free and MARK not in text:
            # the usual case: words apart by single spaces or line feeds, which never merge
            parts = text.replace("\n", " \n").split(" ")
            if "" not in parts:
                counts = list(map(self.words.get, parts))
                if None in counts:
                    counts = [self._word(p) if n is None else n for p, n in zip(parts, counts)]
                return sum(counts)
        marked = MARK + text.replace(" ", MARK)
        return sum(map(self.run, _PIECE.findall(marked) if self.split else [marked]))

    def _word(self, word: str) -> int:
        if len(self.words) >= MEMO:
            self.words.clear()
        n = self.run(word if word[0] == "\n" else MARK + word)
        if len(word) <= 64:
            self.words[word] = n
        return n


_loaded: dict[str, Merger] = {}


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _loaded.get(model_file)
        if merger is None:
            merger = _loaded[model_file] = Merger(model_file)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            tokens = [merger.count(x) for x in texts]
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            cols = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
