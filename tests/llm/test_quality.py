"""Line rules and base measures against a slow plain version."""

from __future__ import annotations

import re
from collections import Counter

from medley.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
        len(words) < 50 or 100 * len(hit) > 50 * len(words),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_equal_plain_version(docs, edge_rows, sample):
    rows = edge_rows + sample + [(900, "a b a b a b a"), (901, "x\nx \nx\n\n\nx"), (902, "é é é\n|é\x85é\xa0\x1c")]
    got = quality.quality(docs(rows), with_text=False).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in MEASURES)) for r in got), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    assert quality.quality(docs([])).count() == 0


BODY = "\n".join(f"Plain{i} sentence{i} number{i} has few{i} ordinary{i} words, and ends{i} here." for i in range(12))


def verdict(text):
    return quality.judge(text.encode(), 0.3, 0.1, 0.5)


def test_line_rules():
    assert verdict(BODY)["kept"] and verdict(BODY)["clean_text"].decode() == BODY
    for bad in ("Home | About | Contact", "THIS!! IS!! LOUD!!", "All Rights Reserved, 2020.", "no " * 40, "See >> more"):
        r = verdict(BODY + "\n" + bad)
        assert r["kept"] and r["clean_text"].decode() == BODY, bad
    noisy = "\n".join(line.replace(" ", "%%% ") for line in BODY.split("\n"))
    assert not verdict(noisy)["kept"]
    assert not verdict("\n".join(["Home | About | Contact | Help"] * 30 + [BODY]))["kept"]


def test_clean_keeps_columns_and_good_documents(spark, docs):
    from pyspark.sql import functions as F

    rows = [(1, BODY), (2, None), (3, "short"), (4, BODY + "\nHome | About | Contact")]
    table = docs(rows).withColumn("row", F.lit("x")).withColumn("verdict", F.lit(1)).withColumn("a.b", F.lit(2))
    got = {r["doc_id"]: r for r in quality.clean(table).collect()}
    assert set(got) == {1, 4} and got[4]["text"] == BODY and got[4]["n_chars"] == len(BODY)
    assert quality.clean(table).columns == table.columns and got[1]["row"] == "x" and got[1]["verdict"] == 1
    assert quality.clean(docs([])).count() == 0
