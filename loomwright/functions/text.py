"""Token functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
_FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def tokens(text: Column, lower: bool = True, max_length: int | None = 40, fold: bool = False, stop_words: tuple[str, ...] = (), base: str = "simple", ngram: tuple[int, int] = (3, 3), prefix_only: bool = False) -> Column:
    """The tokens of a text in order. base: simple (runs of letters and digits), whitespace, raw (the whole text) or ngram."""
    text = F.lower(text) if lower else text
    if base == "simple" and max_length is not None:  # no lambda: a long run of letters is blanked before the split
        text, max_length = F.regexp_replace(text, rf"[\p{{L}}\p{{N}}]{{{max_length + 1},}}", " "), None
    if base == "raw":
        out = F.array(text)
    elif base == "whitespace":
        out = F.split(text, r"\s+")
    elif base == "simple":
        out = F.split(text, SPLIT)
    elif base == "ngram":
        size = F.length(text)
        parts = []
        for n in range(ngram[0], ngram[1] + 1):
            last = F.when(size >= n, F.lit(1) if prefix_only else size - n + 1)
            parts.append(F.when(size >= n, F.transform(F.sequence(F.lit(1), F.coalesce(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
        out = F.concat(*parts)
    else:
        raise ValueError(f"unknown tokenizer {base!r}")
    out = F.array_remove(out, "")
    if fold:
        out = F.transform(out, lambda t: F.translate(t, *_FOLD))
    if max_length is not None and base != "raw":
        out = F.filter(out, lambda t: F.length(t) <= max_length)
    if stop_words:
        out = F.filter(out, lambda t: ~t.isin(*stop_words))
    return out


def contains_tokens(text: Column, query: Column) -> Column:
    """Whether every token of the query occurs in the text, case and all; null for a null text."""
    return F.size(F.array_except(tokens(query, lower=False, max_length=None), tokens(text, lower=False, max_length=None))) == 0


#: Bytes of text whose tokens are in memory at a time.
SLAB = 4 << 20


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case, code point by code point: what stands in a text stands, lowered, in the lowered text."""
    return pc.utf8_lower(texts)


def slabs(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column (or of lists of tokens) of about `SLAB` bytes, a longer row by itself, and where each begins."""
    size = pc.fill_null(pc.binary_length(column), 0) if not pa.types.is_list(column.type) else pc.multiply(pc.fill_null(pc.list_value_length(column), 0), 8)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLAB, "right")))
        yield row, column.slice(row, stop - row)
        row = stop


def split_tokens(column: pa.Array, lower: bool = True, max_length: int | None = 40) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """As `tokens` of base simple, for Arrow texts; lists are taken as tokens already. Tokens in order, the row and the place in it of each, and every row's number of them."""
    if pa.types.is_list(column.type):
        values, row = column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    else:
        lists = pc.split_pattern_regex(lowered(column) if lower else column, pattern=SPLIT)
        values, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        size = pc.utf8_length(values).to_numpy(zero_copy_only=False)
        ok = (size > 0) & (size <= (max_length or size.max(initial=0)))
        values, row = values.filter(pa.array(ok)), row[ok]
    length = np.bincount(row, minlength=len(column))
    return values, row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length), length


def trigrams(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different runs of three code points of lower-cased texts; where the rows of each begin (one more at the end), and those rows, each once."""
    low = lowered(texts)
    size = pc.fill_null(pc.utf8_length(low), 0).to_numpy(zero_copy_only=False)
    point = np.frombuffer("".join(x or "" for x in low.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    ok = row[:-2] == row[2:]
    grams, number = np.unique((point[:-2] | point[1:-1] << np.uint64(21) | point[2:] << np.uint64(42))[ok], return_inverse=True)
    both = np.unique(number * len(size) + row[:-2][ok])
    n, row = np.divmod(both, max(1, len(size)))
    mask = np.uint64((1 << 21) - 1)
    text = np.stack([grams & mask, grams >> np.uint64(21) & mask, grams >> np.uint64(42)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 3] for i in range(0, len(text), 3)], np.searchsorted(n, np.arange(len(grams) + 1)), row
