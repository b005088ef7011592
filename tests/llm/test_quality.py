import re
from collections import Counter

from loomwright.llm.quality import LineRules, quality_filter, quality_report

from . import brute

GOOD = "\n".join(" ".join(f"word{i}x{j}" for j in range(30)) + "." for i in range(4))
BAD = [
    "home | about | news | contact | help",
    "All rights reserved.",
    "BUY!! NOW!! CHEAP!! PILLS!! HERE!!.",
    "a line without an end",
    "if (x) { return; }",
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_base_counts_equal_brute_force(spark):
    rows = brute.corpus(3) + [(70_000, "a b c " * 40, None, None, 0), (70_001, "x\x85y z\x1f | # $$ \n\n dup\ndup\n", None, None, 0)]
    got = quality_report(spark.createDataFrame(rows, brute.SCHEMA)).collect()
    assert brute.order(tuple(r)[:7] for r in got) == brute.order((i, *base(t)) for i, t, *_ in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_lines(spark):
    rules = LineRules()
    assert all(rules.keeps(x) for x in GOOD.split("\n"))
    assert not any(rules.keeps(x) for x in BAD)
    junk = "\n".join([GOOD.split("\n")[0], *(BAD[0] + f" page {i} | x" for i in range(20))])
    rows = [(1, GOOD, "en", "a", 5), (2, GOOD + "\n" + BAD[1], "en", "a", 5), (3, junk, "en", "a", 5), (4, None, "en", "a", None)]
    kept = {r["doc_id"]: r for r in quality_filter(spark.createDataFrame(rows, brute.SCHEMA)).collect()}
    assert set(kept) == {1, 2}
    assert kept[2]["text"] == GOOD and kept[2]["n_chars"] == len(GOOD)


def test_labelled_documents(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality_report(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert not [r for r in got if labels.get(r["doc_id"]) == 0 and r["kept"]]
    assert not [r for r in got if labels.get(r["doc_id"]) == 1 and not r["kept"] and not r["base_failed"]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], brute.SCHEMA)
    assert quality_report(docs).count() == 0 and quality_filter(docs).count() == 0


def test_odd_rows_clashing_names_and_own_lists(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(1500))
    rows = [(None, None, 1, "k"), (1, "", 1, "k"), (2, long, 1, "k"), (2, long, 1, "k"), (3, "\n".join([GOOD, "buy our stock phrase."] * 3), 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality_report(docs).collect())
    assert got[:4] == [(0, 0, False), (1, 0, False), (2, 60_000, True), (2, 60_000, True)]
    kept = quality_filter(docs, LineRules(max_repeat_percent=100, phrases=("stock phrase",)))
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[2] == long and "stock" not in texts[3] and kept.count() == 3
    assert quality_filter(docs.limit(0)).count() == quality_report(docs.limit(0)).count() == 0
