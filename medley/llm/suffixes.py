"""Removal of repeated passages with a sampled, range-partitioned suffix array over UTF-8 bytes.

A byte is removed when a string of `LENGTH` bytes that covers it also starts earlier, in a smaller document or
earlier in the same one. Sorting every suffix would move each byte many times over, so suffixes are sampled by
content: of every window of LENGTH bytes the suffix whose leading `LEAD` bytes hash lowest is kept (about one in
25). Equal windows keep the suffix at the same offset, so every repeated window shows as two kept suffixes with
equal leading bytes, at most LENGTH - LEAD bytes after the window's start. The steps:

1. Sample suffixes where the texts are read. Of those with one context (all bytes that any window over the
   suffix can reach) only the first of a batch goes on; the others are repeats and only leave their span.
2. Shuffle (hash of the leading bytes, hash of the context, place), sort, and in one streaming pass drop the
   suffixes whose leading bytes occur once, keep the first of every context and write out the others' spans.
3. Fetch the bytes around what is left where leading bytes go with several contexts, and range-partition
   these suffixes by their leading bytes with sampled splitters. Equal leading bytes never cross a splitter,
   so no comparison across buckets is left to do.
4. In a bucket, sort suffixes and the reversed bytes before them by multikey quicksort on 8-byte keys. Common
   prefix lengths of neighbours give, for each offset, the classes of equal windows; all but a class's first
   member are repeats. This step compares bytes, not hashes.
5. Merge each document's spans and cut them out.

A group of more than `hot` contexts with the same leading bytes is not held in a task: its windows are sent as
rows of their own, keyed by a 128-bit hash, and compared in the same streaming way (same result).
The hashes of steps 1, 2 and of hot groups are taken for equality at 128 bits.

Defined results: null and empty texts have no bytes and lose none; texts shorter than LENGTH lose none; null ids
are smallest; rows that share an id are ordered by a hash of their text, and equal rows count as one document
whose result every one of them gets; an empty table gives an empty table; other columns are ignored. Long
texts are sampled in segments, so memory is bounded by a segment in step 1 and by a text in steps 3 and 5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from medley.llm.common import NULL_ID, keyed, utf8, written

LENGTH = 100
LEAD = 50
REACH = LENGTH - LEAD  # bytes a window can start before its kept suffix
SEGMENT = 1 << 17
HOT = 50_000
CHUNK = 40_000

_u = np.uint64
_bytes = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    with np.errstate(over="ignore"):
        out = a * _u(0x9E3779B97F4A7C15)
        t = b >> _u(29)
        t ^= b
        t *= _u(0xC2B2AE3D27D4EB4F)
        out += t
    np.right_shift(out, _u(32), out=t)
    out ^= t
    return out


def _doubled(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over all runs of `width` neighbours, by doubling (overlap allowed for min, max and hashing alike)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = f(a[: len(a) - step], a[step:])
        have += step
    return a


def lead_hashes(buf: np.ndarray) -> np.ndarray:
    return _doubled(_bytes[buf], LEAD, _join)


def sampled(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text index, place, bytes to the end up to LENGTH, lead hash, context hash) of the kept suffixes, in order."""
    parts = []
    group: list[tuple[int, int, int, int]] = []  # text, first byte of the segment, window starts low..high
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            parts.append(_sample(texts, group))
        group, size = [], 0

    for i, text in enumerate(texts):
        windows = len(text) - LENGTH + 1
        for low in range(0, max(windows, 0), SEGMENT):
            high = min(windows, low + SEGMENT)
            base = max(0, low - REACH)
            group.append((i, base, low, high))
            size += high - base
            if size >= SEGMENT:
                flush()
    flush()
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    out = [np.concatenate(c) for c in zip(*parts)]
    # Two segments of one text may keep the same suffix.
    again = (out[0][1:] == out[0][:-1]) & (out[1][1:] <= out[1][:-1])
    if again.any():
        order = np.lexsort((out[1], out[0]))
        out = [c[order] for c in out]
        new = np.r_[True, (out[0][1:] != out[0][:-1]) | (out[1][1:] != out[1][:-1])]
        out = [c[new] for c in out]
    return tuple(out)


def _sample(texts: list[bytes], group: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    pieces = [texts[i][base : high + 2 * LENGTH] for i, base, _, high in group]
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    text, base, low, high = (np.array(c) for c in zip(*group))
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    h = lead_hashes(buf)
    least = _doubled(h, REACH + 1, np.minimum)
    marks = np.zeros(len(buf) + 1, np.int64)
    np.add.at(marks, starts + low - base, 1)
    np.add.at(marks, starts + high - base, -1)
    inside = np.cumsum(marks)[: len(least)] > 0
    # A suffix is kept if it is the least of any window over it: the largest of those windows' minima is its own hash.
    shown = np.concatenate([np.zeros(REACH, np.uint64), np.where(inside, least, _u(0)), np.zeros(REACH, np.uint64)])
    best = _doubled(shown, REACH + 1, np.maximum)[: len(h)]
    at = np.flatnonzero((best == h[: len(best)]) & (best != 0))
    seg = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[seg] + base[seg]
    ends = np.array([len(texts[i]) for i in text])
    before = np.minimum(place, REACH)
    after = np.minimum(ends[seg] - place, LENGTH)
    context = ((before << 8) | after).astype(np.uint64)
    for hop in range(0, REACH + LENGTH, LEAD):
        context = _join(context, h[np.minimum(at - before + hop, at + after - LEAD)])
    return text[seg], place, after, h[at], context


SUFFIXES = "g long, c long, k long, tie long, p int, r int"
_suffixes = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("k", pa.int64()), ("tie", pa.int64()), ("p", pa.int32()), ("r", pa.int32())])


def _sample_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1. Spans of repeats inside the batch carry a negative r and a group of their own."""
    for batch in it:
        k, tie = batch.column("k").to_numpy(), batch.column("tie").to_numpy()
        order = np.lexsort((tie, k))
        texts = utf8(batch, "text")
        doc, p, r, h, c = sampled([texts[i] for i in order])
        k, tie = k[order][doc], tie[order][doc]
        both = _join(h, c)
        by = np.argsort(both, kind="stable")
        same = np.r_[False, (h[by][1:] == h[by][:-1]) & (c[by][1:] == c[by][:-1])]
        again = np.zeros(len(by), bool)
        again[by] = same
        # A row equal to an earlier one brings the same suffixes: they are the group's first itself, not repeats of it.
        first = np.empty(len(by), np.int64)
        first[by] = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        keep = ~again | (k != k[first]) | (tie != tie[first]) | (p != p[first])
        k, tie, p, r, h, c, again = (x[keep] for x in (k, tie, p, r, h, c, again))
        g = np.where(again, _join(_join(k.astype(np.uint64), tie.astype(np.uint64)), p.astype(np.uint64)), h).view(np.int64)
        columns = [g, np.where(again, _u(0), c).view(np.int64), k, tie, p.astype(np.int32), np.where(again, -r, r).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=_suffixes)


FOUND = "kind int, g long, k long, tie long, p int, r int"
_found = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("k", pa.int64()), ("tie", pa.int64()), ("p", pa.int32()), ("r", pa.int32())])
SPAN, OPEN = 0, 1


def _first_of_contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by (g, c, k, tie, p). The last first-of-a-context waits for its successor."""
    last = None  # g, c, k, tie, p of the last row
    waiting = None  # g, k, tie, p, r, whether its group has an earlier context

    def rows(kind, g, k, tie, p, r):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int32)), *(pa.array(x) for x in (g, k, tie, p, r))], schema=_found)

    for batch in it:
        g, c, k, tie, p, r = (batch.column(n).to_numpy() for n in ("g", "c", "k", "tie", "p", "r"))
        done = r < 0
        if done.any():
            yield rows(SPAN, g[done], k[done], tie[done], p[done], -r[done])
            g, c, k, tie, p, r = (x[~done] for x in (g, c, k, tie, p, r))
        if not len(g):
            continue
        before = last or (~g[0], c[0], k[0], tie[0], p[0])
        g0, c0, k0, t0, p0 = (np.r_[b, x[:-1]] for b, x in zip(before, (g, c, k, tie, p)))
        new_g = g != g0
        new_c = new_g | (c != c0)
        again = ~new_c & ((k != k0) | (tie != t0) | (p != p0))  # equal documents repeat whole rows
        last = tuple(x[-1] for x in (g, c, k, tie, p))
        if again.any():
            yield rows(SPAN, g[again], k[again], tie[again], p[again], r[again])
        firsts = [x[new_c] for x in (g, k, tie, p, r)]
        later = ~new_g[new_c]
        if waiting is not None:
            firsts = [np.r_[np.array([w], x.dtype), x] for w, x in zip(waiting[:5], firsts)]
            later = np.r_[waiting[5], later]
        if not len(later):
            continue
        shared = later[:-1] | later[1:]
        if shared.any():
            yield rows(OPEN, *(x[:-1][shared] for x in firsts))
        waiting = (*(x[-1] for x in firsts), later[-1])
    if waiting is not None and waiting[5]:
        yield rows(OPEN, *(np.array([w], t.type.to_pandas_dtype()) for w, t in zip(waiting[:5], list(_found)[1:])))


AROUND = "lead binary, rest binary, before binary, k long, tie long, p int, o int"
_around = pa.schema([
    ("lead", pa.binary()), ("rest", pa.binary()), ("before", pa.binary()), ("k", pa.int64()), ("tie", pa.int64()), ("p", pa.int32()), ("o", pa.int32()),
])


def _surroundings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: bytes around the open suffixes; for hot groups a hash per window, with its offset in `o`."""
    for batch in it:
        for text, k, tie, places, hot in zip(utf8(batch, "text"), *(batch.column(n).to_pylist() for n in ("k", "tie", "places", "hot"))):
            rows: list[tuple] = []
            for p, is_hot in zip(places, hot):
                if not is_hot:
                    rows.append((text[p : p + LEAD], text[p + LEAD : p + LENGTH], text[max(0, p - REACH) : p][::-1], p, -1))
                    continue
                for o in range(max(0, LENGTH - len(text) + p), min(p, REACH) + 1):
                    window = text[p - o : p - o + LENGTH]
                    rows.append((hashlib.blake2b(window, digest_size=16).digest(), b"", b"", p, o))
            if rows:
                lead, rest, before, p, o = zip(*rows)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead, pa.binary()), pa.array(rest, pa.binary()), pa.array(before, pa.binary()), pa.array([k] * n, pa.int64()), pa.array([tie] * n, pa.int64()), pa.array(p, pa.int32()), pa.array(o, pa.int32())],
                    schema=_around,
                )


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows by their 8-byte keys, left to right: only rows that still tie are sorted by the next key."""
    order = np.arange(len(keys))
    tied = np.array([0, len(keys)])[None, :] if len(keys) > 1 else np.zeros((0, 2), int)
    for column in range(keys.shape[1]):
        if not len(tied):
            break
        sizes = tied[:, 1] - tied[:, 0]
        group = np.repeat(np.arange(len(tied)), sizes)
        at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(tied[:, 0], sizes)
        rows = order[at]
        key = keys[rows, column]
        by = np.lexsort((key, group))
        order[at] = rows[by]
        key, group = key[by], group[by]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]), True])
        long = np.flatnonzero(np.diff(cut) > 1)
        begin = at[cut[long]]
        tied = np.stack([begin, begin + np.diff(cut)[long]], axis=1)
    return order


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded bytes, lengths, and big-endian 8-byte keys."""
    full = -(-width // 8) * 8
    m = np.frombuffer(b"".join(s.ljust(full, b"\0") for s in strings), np.uint8).reshape(len(strings), full)
    return m, np.array([len(s) for s in strings]), m.view(">u8").astype(np.uint64)


def _neighbour_classes(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the strings, common prefix lengths of neighbours in it, and lengths."""
    m, lengths, keys = _matrix(strings, width)
    # The length comes last: zero bytes equal the padding, and only equal strings may stand between equal strings.
    order = multikey_order(np.column_stack([keys, lengths.astype(np.uint64)]))
    a, b = m[order][1:], m[order][:-1]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(a) else np.zeros(0, int)
    return order, np.minimum(common, np.minimum(lengths[order][1:], lengths[order][:-1])), lengths


def repeated_spans(suffixes: list[bytes], before: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 4 for rows in document order: (row, start, end) of the bytes covered by repeated windows over each suffix.

    All windows of a row start within REACH < LENGTH bytes, so their union has no gap.
    """
    n = len(suffixes)
    right_order, right_common, right = _neighbour_classes(suffixes, LENGTH)
    left_order, left_common, left = _neighbour_classes(before, REACH)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(REACH + 1):
        right_class[right_order] = np.cumsum(np.r_[0, right_common < LENGTH - o])
        left_class[left_order] = np.cumsum(np.r_[0, left_common < o])
        rows = np.flatnonzero((right >= LENGTH - o) & (left >= o))
        _, first, group = np.unique(right_class[rows] * n + left_class[rows], return_index=True, return_inverse=True)
        again = rows[first[group] != np.arange(len(rows))]
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], o)
    rows = np.flatnonzero(high >= 0)
    return rows, places[rows] - high[rows], places[rows] - low[rows] + LENGTH


SPANS = "k long, tie long, start int, end int"
_spans = pa.schema([("k", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4 over rows sorted by (lead, k, tie, p): whole groups, some together; hot windows one by one."""
    held: list[tuple] = []
    window = place = None

    def resolved(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda x: (x[3], x[4], x[5]))
        places = np.array([x[5] for x in rows], np.int64)
        at, start, end = repeated_spans([x[0] + x[1] for x in rows], [x[2] for x in rows], places)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][3] for i in at], pa.int64()), pa.array([rows[i][4] for i in at], pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            schema=_spans,
        )

    for batch in it:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            lead, _, _, k, tie, p, o = row
            if o >= 0:
                if lead != window:
                    window, place = lead, (k, tie, p - o)
                elif (k, tie, p - o) != place:
                    out.append((k, tie, p - o, p - o + LENGTH))
                continue
            if len(held) >= CHUNK and lead != held[-1][0]:
                yield resolved(held)
                held = []
            if held and held[-1][3:6] == (k, tie, p):
                continue  # an equal row's bytes
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _spans)], schema=_spans)
    if held:
        yield resolved(held)


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, text (bytes) and its removed spans (sorted, merged, end exclusive) of every document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_col, text_col).select("k", "tie", "text")
    found = written(
        texts.mapInArrow(_sample_batches, SUFFIXES)
        .repartition(parts, "g")
        .sortWithinPartitions("g", "c", "k", "tie", "p")
        .mapInArrow(_first_of_contexts, FOUND)
    )
    opened = found.where(F.col("kind") == OPEN)
    large = opened.groupBy("g").count().where(F.col("count") > hot).select("g", F.lit(True).alias("hot"))
    by_text = (
        opened.join(large, "g", "left")
        .groupBy("k", "tie")
        .agg(F.collect_list(F.struct("p", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("at"))
        .select("k", "tie", F.col("at.p").alias("places"), F.col("at.hot").alias("hot"))
    )
    compared = (
        texts.join(by_text.hint("shuffle_hash"), ["k", "tie"])
        .select("k", "tie", "text", "places", "hot")
        .mapInArrow(_surroundings, AROUND)
        .repartitionByRange(parts, "lead")
        .sortWithinPartitions("lead", "k", "tie", "p")
        .mapInArrow(_compare, SPANS)
    )
    whole = found.where(F.col("kind") == SPAN).select(
        "k", "tie", (F.col("p") - F.least("p", F.lit(REACH))).alias("start"), (F.col("p") + F.col("r")).alias("end")
    )
    spans = whole.unionByName(compared).groupBy("k", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(spans.hint("shuffle_hash"), ["k", "tie"], "left").select(
        F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"), "text", "spans"
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the bytes kept."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_kept)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for i, text, spans in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), batch.column("spans").to_pylist()):
                merged = _merged(spans)
                edges = [0, *(x for span in merged for x in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((i, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return repeats(docs, id_col, text_col, hot).mapInArrow(cut, ddl)
