"""Quality rules, line first: bad lines are taken out, then documents that lose too much are rejected.

A line with a word fails when
* punctuation: more than `max_punctuation` of its non-space bytes are ASCII punctuation other than full
  stops and commas (markup residue, shouting, symbol noise);
* navigation: it holds at least two separators `|` or `>>`, or one and at most six words;
* boilerplate: it holds one of the fixed phrases, in any case;
* repetition: one word makes up more than `max_same_word` of its words, counted from ten words on.

A document is rejected when it fails the base rules (fewer than 50 words, or more than half of its words
inside repeated three-word windows) or when failed lines hold more than `max_lost` of its word bytes.

Defined results: null and empty texts have no words and are rejected; lines without a word never fail and
are kept as they are; rows with equal ids or equal texts are judged one by one; an empty table gives an
empty table; other columns pass through `clean` untouched and are not looked at. Everything is local to
a row, so no step shuffles.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import batches, only, utf8

SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture.
BOILERPLATE = (
    b"all rights reserved", b"click here", b"cookie policy", b"enable javascript", b"lorem ipsum",
    b"privacy policy", b"sign up for our newsletter", b"subscribe to our newsletter", b"terms of service", b"terms of use",
)
NOISE = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50

_phrases = re.compile(b"|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_separator = re.compile(rb"\||>>")


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    n = len(number)
    if n < 2_000_000:
        windows = (w[:-2] * n + w[1:-1]) * n + w[2:]
    else:  # three numbers no longer fit one long
        _, pairs = np.unique(w[:-1] * n + w[1:], return_inverse=True)
        windows = pairs[:-1] * n + w[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = order[np.r_[False, same] | np.r_[same, False]]
    hit = np.zeros(len(w), bool)
    for i in range(3):
        hit[again + i] = True
    return int(hit.sum())


def failed(line: bytes, words: list[bytes], max_punctuation: float, max_same_word: float) -> bool:
    size = sum(map(len, words))
    if size - len(line.translate(None, SPACE + NOISE)) > max_punctuation * size:
        return True
    cuts = len(_separator.findall(line))
    if cuts > 1 or (cuts and len(words) <= 6):
        return True
    if len(words) >= 10 and Counter(words).most_common(1)[0][1] > max_same_word * len(words):
        return True
    return _phrases.search(line) is not None


def judge(text: bytes, max_lost: float, max_punctuation: float, max_same_word: float) -> dict:
    words = text.split()
    word_bytes = sum(map(len, words))
    seen: set[bytes] = set()
    duplicates = lost = 0
    kept_lines = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            duplicates += line in seen
            seen.add(line)
            if failed(line, own, max_punctuation, max_same_word):
                lost += sum(map(len, own))
                continue
        kept_lines.append(line)
    repeats = repeated_window_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": word_bytes if text.isascii() else len(text.decode()) - (len(text) - word_bytes),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= max_lost * word_bytes,
        "lost_bytes": lost,
        "clean_text": b"\n".join(kept_lines),
    }


COLUMNS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "lost_bytes": pa.int64(), "clean_text": pa.string(),
}
DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_bytes long, clean_text string"
)


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_lost: float = 0.3,
    max_punctuation: float = 0.1,
    max_same_word: float = 0.5,
    with_text: bool = True,
) -> DataFrame:
    """One row per document: id, the measures, the verdict and, on request, the text without failed lines."""
    names = [c for c in COLUMNS if with_text or c != "clean_text"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, COLUMNS[c]) for c in names)])

    def rows(batch: pa.RecordBatch) -> dict:
        found = [judge(t, max_lost, max_punctuation, max_same_word) for t in utf8(batch, "text")]
        return {"doc_id": batch.column("doc_id")} | {c: [r[c] for r in found] for c in names}

    ddl = "doc_id long, " + ", ".join(part for part in DDL.split(", ") if part.split()[0] in names)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(batches(schema, rows), ddl)


def clean(docs: DataFrame, text_col: str = "text", **rules) -> DataFrame:
    """The documents kept, with all their columns, their text without failed lines and `n_chars` counted anew."""
    limits = {"max_lost": 0.3, "max_punctuation": 0.1, "max_same_word": 0.5} | rules

    @F.pandas_udf("kept boolean, text string")
    def judged(texts: pd.Series) -> pd.DataFrame:
        only()
        found = [judge((t or "").encode(), **limits) for t in texts]
        return pd.DataFrame({"kept": [r["kept"] for r in found], "text": [r["clean_text"].decode() for r in found]})

    # Not deterministic for the optimizer: else the filter would judge every text a second time.
    verdict = judged.asNondeterministic()(F.col(text_col)).alias("verdict")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), verdict).where("verdict.kept")
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("verdict.text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns[text_col]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(value.alias(c) for c, value in columns.items()))
