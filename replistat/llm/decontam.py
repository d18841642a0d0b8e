"""Benchmark decontamination by canonical templates, hash-joined windows and consistent slots."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import packed, row_key, table, written

WIDTH, LEAST = 8, 4  # words of a window; shorter items form one window of their own, and below LEAST words only a whole document matches
NEED = 6  # this many windows of an item, or half of them, make a document contaminated
PART = 4_000_000  # characters worked on at once
FILTER_BITS = 23  # the window filter is a bitmap of 2**FILTER_BITS bits, 1 MiB, whatever the benchmark's size
EDGE = "\"'`´’‘“”«»„()[]{}<>.,;:!?…*_~|"
#: Unit words that follow a number.
UNITS = frozenset("""mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons ounce ounces oz lb lbs pound pounds ml l liter liters litre litres
gallon gallons second seconds sec s minute minutes min hour hours h day days week weeks month months year years percent % dollar dollars cent cents euro euros
degree degrees mph kmh km/h""".split())
SLOTS = {"num": 1, "unit": 2, "name": 3}
WORD, NUM, UNIT_WORD = 0, 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def describe(word: str) -> tuple[int, int, bool, bool, str]:
    """Hash of the bare lower-case word, kind, written as a name (capital first, not all capitals), ends a sentence, bare word."""
    bare = word.strip(EDGE)
    low = bare.lower()
    digits = low.lstrip("+-$€£").rstrip("%")
    kind = NUM if digits[:1].isdigit() and all(c.isdigit() or c in ".,:/-" for c in digits) else UNIT_WORD if low in UNITS else WORD
    return xxhash.xxh3_64_intdigest(low), kind, bare[:1].isupper() and not bare.isupper(), word.rstrip("\"'’”»)]")[-1:] in ".!?:", low


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of all texts in turn: template hash, hash of the bare lower-case word, slot kind (0: none), text number; distinct bare words and their index.

    Numbers, units after a number and capitalised words inside a sentence become typed placeholders;
    all else is the bare lower-case word. Words without a letter or digit are left out.
    """
    seen: dict[str, int] = {}
    ids: list[int] = []
    counts = []
    number = seen.setdefault
    for t in texts:
        words = t.split()
        ids += [number(w, len(seen)) for w in words]
        counts.append(len(words))
    about = [describe(w) for w in seen]
    which = np.array(ids, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    low = [a[4] for a in about]
    ends = np.array([a[3] for a in about], bool)[which] if about else np.zeros(0, bool)
    real = np.array([bool(x) for x in low], bool)[which] if about else np.zeros(0, bool)
    first = np.ones(which.size, bool)
    first[1:] = (owner[1:] != owner[:-1]) | ends[:-1]
    which, owner, first = which[real], owner[real], first[real]
    h = np.array([a[0] for a in about], np.uint64)[which]
    kind = np.array([a[1] for a in about], np.int8)[which]
    capital = np.array([a[2] for a in about], bool)[which]
    after_number = np.zeros(which.size, bool)
    after_number[1:] = (kind[:-1] == NUM) & (owner[1:] == owner[:-1])
    slot = np.select([kind == NUM, (kind == UNIT_WORD) & after_number, capital & ~first], [1, 2, 3], 0).astype(np.int8)
    return np.where(slot > 0, slot.astype(np.uint64), h), h, slot, owner, low, which


def window_hashes(h: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of all windows that lie in one text."""
    n = h.size - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = out * MIX + h[j:j + n]
        out ^= out >> np.uint64(29)
    at = np.flatnonzero(owner[:n] == owner[width - 1:])
    return at, out[at]


def _rows(batches: Iterator[pa.RecordBatch], widths: list[int], bitmap: np.ndarray | None, per_item: bool) -> Iterator[pa.RecordBatch]:
    """(id, h, pos, slots, words) of windows; for items every window, for documents those in the bitmap.

    A window with slots comes a second time by its lower-case words, without slots: verbatim copies meet
    there in any case of letters. Where more than half of the words are slots it comes only so, as
    placeholders alone would meet any table of numbers.
    """
    for rb in batches:
        texts = [t or "" for t in rb.column("text").to_pylist()]
        size = np.cumsum([len(t) + 1 for t in texts])
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART)))
            h, bare, slot, owner, low, which = tokens(texts[at:end])
            count = np.bincount(owner, minlength=end - at)
            begin = np.concatenate([[0], np.cumsum(count)])
            before = np.concatenate([[0], np.cumsum(slot > 0)])
            for width, folded in ((w, f) for w in widths for f in (False, True)):
                start, hashes = window_hashes(bare if folded else h, owner, width)
                whole = count[owner[start]] == width
                if per_item:  # an item shorter than a window is one window
                    ok = whole | (width == WIDTH)
                else:
                    bit = hashes >> np.uint64(64 - FILTER_BITS)
                    ok = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                    ok &= whole | (width >= LEAST)  # a shorter item is found only where it is all there is
                held = before[start + width] - before[start]
                ok &= held > 0 if folded else 2 * held <= width
                start, hashes = start[ok], hashes[ok]
                if not start.size:
                    continue
                slots = [[] if folded else [f"{slot[i]}{low[which[i]]}" for i in range(s, s + width) if slot[i]] for s in start.tolist()]
                own = owner[start]
                yield pa.RecordBatch.from_arrays([
                    rb.column("id").take(pa.array(own + at)), pa.array(hashes.view(np.int64)), pa.array((start - begin[own]).astype(np.int32)),
                    pa.array(slots, pa.list_(pa.string())), pa.array(count[own].astype(np.int32)),
                ], names=["id", "h", "pos", "slots", "words"])
            at = end


def windows(df: DataFrame, id_: Column, text: Column, widths: list[int], bitmap: np.ndarray | None = None) -> DataFrame:
    src = df.select(id_.alias("id"), text.alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, h long, pos int, slots array<string>, words int"
    held = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None
    return src.mapInArrow(lambda it: _rows(it, widths, held.value if held else None, held is None), schema)


def agreeing(windows: list[dict]) -> list[int]:
    """Item windows of one diagonal that count: slots equal to the item's, or each with the value that most windows give it.

    Of values given equally often the item's own wins, else the first.
    """
    votes: dict[str, Counter] = {}
    for w in windows:
        for x in w["z"]:
            votes.setdefault(x["q_slots"], Counter())[x["slots"]] += 1
    best = {q: min(c, key=lambda v: (-c[v], v != q, v)) for q, c in votes.items()}
    return sorted({w["q"] for w in windows if all(x["slots"] == x["q_slots"] for x in w["z"]) or all(x["slots"] == best[x["q_slots"]] for x in w["z"])})


def _agreeing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        good = [agreeing(ws.as_py()) for ws in rb.column("w")]
        at = pa.array(np.repeat(np.arange(rb.num_rows), [len(g) for g in good]))
        yield pa.RecordBatch.from_arrays([*[rb.column(c).take(at) for c in ("id", "item", "n_windows")], pa.array([q for g in good for q in g], pa.int32())], names=["id", "item", "n_windows", "q"])


def find_leaks(docs: DataFrame, items: DataFrame, id_: Column, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, n_windows, n_matched) of documents that contain an item or a re-parameterised copy.

    Template windows of WIDTH words of both sides are joined on their hash. A fixed-size bitmap of
    the items' windows drops most document windows before that join; it has no false negatives.
    Matches of one document and item on one diagonal are aligned: there each slot value of the item
    (number, unit, name) stands for the value that most windows give it. Windows with another value are
    dropped, unless they equal the item's word for word in any case of letters; those always count. A
    pair counts with NEED windows of the item, or half of them.

    Null or empty texts have no windows; an item under LEAST words is found in documents that say nothing
    else. Repeated items are reported each; rows that repeat ``id_`` are one document, so ids that may be null or
    repeat are given as ``row_key``. Empty tables give an empty result.
    """
    widths = list(range(1, WIDTH + 1))
    marks = written(windows(items, F.col(item_id), F.col(text_col), widths))
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = marks.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 AS INT))")).alias("m"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for w, m in words.collect():  # at most 2**17 rows
        bitmap[w] = m
    used = [r[0] for r in marks.select(F.least("words", F.lit(WIDTH)).alias("n")).distinct().collect()]  # at most eight
    hits = windows(docs, id_, F.col(text_col), sorted(used), bitmap.view(np.uint64))
    m = marks.select(F.col("id").alias("item"), "h", F.col("pos").alias("q"), F.col("slots").alias("q_slots"), (F.greatest(F.col("words") - WIDTH, F.lit(0)) + 1).alias("n_windows"))
    pairs = hits.join(m, "h").filter(F.size("slots") == F.size("q_slots")).select("id", "item", "n_windows", "q", (F.col("pos") - F.col("q")).alias("diagonal"), F.arrays_zip("q_slots", "slots").alias("z"))
    ways = pairs.groupBy("id", "item", "n_windows", "diagonal").agg(F.collect_set(F.struct("q", "z")).alias("w")).select("id", "item", "n_windows", "w")
    types = ways.schema
    good = ways.mapInArrow(_agreeing_rows, f"id {types['id'].dataType.simpleString()}, item {types['item'].dataType.simpleString()}, n_windows {types['n_windows'].dataType.simpleString()}, q int")
    found = good.groupBy("id", "item", "n_windows").agg(F.count_distinct("q").alias("n_matched"))
    return found.filter(F.col("n_matched") >= F.least(F.lit(NEED), F.ceil(F.col("n_windows") / 2))).withColumnRenamed("item", "item_id")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    rows = packed(docs, "doc_id", "text").withColumn("__k", row_key(F.col("doc_id"), F.col("text")))
    bad = find_leaks(rows, items, F.col("__k")).select(F.col("id").alias("__k")).distinct()
    return rows.join(bad, "__k", "left_anti").select("__row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = find_leaks(docs, items, row_key(F.col("doc_id"), F.col("text")))
    return found.select(F.when(~F.col("id.missing"), F.col("id.id")).alias("doc_id"), "item_id", "n_windows", "n_matched")


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE: dict[str, str] = {}
