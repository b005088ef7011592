"""Operator 7: line-first cleaning.

Every line is judged by itself. It fails
- navigation, if it holds two or more menu separators (`|`, `»`, `›`, `•`, `→`);
- boilerplate, if it holds a stock phrase (rights, licence, cookie or sign-up notices, code braces);
- punctuation, if it neither ends like a sentence nor holds two sentence ends inside, or if more than a
  tenth of its words carry runs of marks such as `!!`, `***` or `$$$`.
Failing lines are removed, then the document is rejected when more than `max_lost` of its non-space
characters went with them. Document-level base rules (too few words, too much repetition) reject first.

Defined results: null and empty texts have no words and are rejected by the base rule; blank lines cost
nothing; repeated rows are judged each; an empty table gives an empty result; only `text` and the named
columns are read, so others may bear any name. A text is judged whole, whatever its length. Phrases and
separators are parameters; the default phrases are English, the language of the corpus's licence and notice lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PHRASES = (
    "all rights reserved", "licensed under", "license agreement", "terms of use", "terms of service", "privacy policy", "cookie",
    "javascript", "lorem ipsum", "sign up", "subscribe to", "newsletter", "click here", "read more", "copyright (c)", "©",
)
SEPARATORS = "|»›•→"
_RUN = re.compile(r"[!?#*$%&<>]{2}[!?#*$%&<>]*")
_END = re.compile("""[.!?…:;]["'”’»)\\]]*\\Z""")
_STOP = re.compile("[.!?…][ ]")
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class LineRules:
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50
    max_marked: float = 0.1
    #: Stock phrases of boilerplate in lower case, and the characters that separate the entries of a menu.
    phrases: tuple[str, ...] = PHRASES
    separators: str = SEPARATORS

    def keeps(self, line: str, odd: bool = True) -> bool:
        """Whether a line that has a word passes; surrounding space is ignored. Without `odd`, the text holds no separator, phrase or brace."""
        line = line.strip(" \t\n\x0b\x0c\r")
        if odd:
            if sum(map(line.count, self.separators)) >= 2:
                return False
            low = line.lower()
            if any(p in low for p in self.phrases) or "{" in line or "}" in line:
                return False
        if line[-1] != "." and not _END.search(line) and len(_STOP.findall(line)) < 2:
            return False
        if not _RUN.search(line):
            return True
        return len(_RUN.findall(line)) <= self.max_marked * len(line.encode("utf-8", "surrogatepass").split())

    def clean(self, text: str) -> tuple[str, int, int]:
        """The text of the lines kept, and the non-space characters of it and of the whole text."""
        lines = text.split("\n")
        kept, left, whole = [], 0, 0
        low = text.lower()
        odd = any(map(low.__contains__, (*self.phrases, *self.separators, "{", "}")))
        for line in lines:
            n = solid(line)
            whole += n
            if n == 0 or self.keeps(line, odd):
                kept.append(line)
                left += n
        return "\n".join(kept), left, whole


def solid(text: str) -> int:
    """Code points that are not of the six space characters."""
    return len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in three-word windows found twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    v = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    grams = (v[:-2] << 42) | (v[1:-1] << 21) | v[2:] if len(ids) < 1 << 21 else np.unique(np.stack([v[:-2], v[1:-1], v[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    same = g[1:] == g[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[1:] |= same
    hit[:-1] |= same
    covered = np.zeros(len(words), bool)
    at = order[hit]
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def judge_text(text: str | None, rules: LineRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    filled = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    repeats = repeat_words(words)
    cleaned, left, whole = rules.clean(text)
    failed = len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)
    kept = not failed and whole - left <= rules.max_lost * whole
    return len(words), whole, sum(map(text.count, _SYMBOLS)), len(filled) - len(set(filled)), repeats, failed, kept, cleaned


_FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()))


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge_text(x.as_py(), rules)[:7] for x in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(n for n, _ in _FIELDS)])

    kinds = {"n": T.LongType(), "w": T.LongType()}
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, kinds.get(n[0], T.BooleanType())) for n, _ in _FIELDS)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def quality_filter(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents kept, without the lines that failed; columns as they came, `n_chars` (if there) counted again."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            rows = [judge_text(x.as_py(), rules)[6:] for x in batch.column(at)]
            keep = pa.array([k for k, _ in rows], pa.bool_())
            texts = [t for k, t in rows if k]
            out = batch.filter(keep)
            cols = list(out.columns)
            cols[at] = pa.array(texts, out.schema.field(at).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(t) for t in texts], pa.int64()).cast(out.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)


def quality_sql(rules: LineRules = LineRules()) -> str:
    word = r"[^\x20\x09-\x0D]+"
    quote = lambda s: s.replace("'", "''")
    phrases = " OR ".join(f"contains(lower(line), '{quote(p)}')" for p in rules.phrases)
    seps = " + ".join(f"(len(line) - len(replace(line, '{s}', '')))" for s in rules.separators)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS words, string_split(text, chr(10)) AS lines FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, raw, regexp_replace(regexp_replace(raw, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line, len(regexp_replace(raw, '[\x20\x09-\x0D]+', '', 'g')) AS n FROM (SELECT r, unnest(lines) AS raw FROM t)),
j AS (SELECT r, raw, n, NOT (({seps}) >= 2 OR {phrases} OR contains(line, '{{') OR contains(line, '}}')
        OR NOT (regexp_matches(line, '[.!?…:;]["''”’»)\]]*$') OR len(regexp_extract_all(line, '[.!?…][ ]')) >= 2)
        OR len(regexp_extract_all(line, '[!?#*$%&<>]{{2,}}')) > {rules.max_marked} * len(regexp_extract_all(line, '{word}'))) AS ok FROM l WHERE n > 0),
k AS (SELECT r, sum(n) AS whole, sum(CASE WHEN ok THEN 0 ELSE n END) AS lost, count(*) - count(DISTINCT raw) AS dups FROM j GROUP BY r),
b AS (SELECT doc_id, len(words) AS n_words, coalesce(whole, 0) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM t LEFT JOIN rep ON rep.r = t.r LEFT JOIN k ON k.r = t.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) AND lost <= {rules.max_lost} * word_chars AS kept FROM b"""
