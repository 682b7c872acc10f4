"""Best-fit packing by patterns and non-negative least squares.

The lengths of all pieces make a histogram of at most `room` counts. Patterns of two or three lengths that fill a
sequence exactly are enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded
down to what the histogram still holds, and the residual counts are packed best-fit-decreasing. All of that works on
the histogram, so it is as large for a thousand documents as for a trillion. The pieces of a length are then numbered
in Spark, and each number looks up the pattern that takes it.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.llm.common import materialise, running
from borewatch.session import ship_package

ROOM, END = 4096, 1
#: Words whose ids a Python worker keeps; texts are encoded in chunks between white space, which no token crosses.
MEMORY = 1_200_000
#: Texts encoded together.
TEXTS = 500
LETTERS = re.compile("([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,]?)")
CONTROLS = "\x1c\x1d\x1e\x1f"
#: Third lengths tried for each first length, and rounds of the fit.
THIRDS, ROUNDS = 8, 300
LEAST_BUCKETS, BUCKET_ROWS = 256, 100_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _letter_encoder(path: str):
    """The tokenizer for runs of lower-case letters with blanks between them, which need neither rules of white space and
    case nor cuts."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    letters = Tokenizer.from_file(path)
    letters.normalizer = None
    letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    return letters


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a memory of the chunks between white space.

    The tokenizer works on pieces between white space, and cuts letters from other characters; so a chunk of Latin
    letters, with or without a stop or comma behind them, has the ids of its letters in lower case and of the mark.
    Unknown runs of letters are encoded together, by the tokenizer's model and bytes alone, as they need no cutting and
    are in lower case already: each of them ends in a token that closes a word.
    """

    def __init__(self, path: str):
        self.tokenizer, self.letters, self.known = _encoder(path), _letter_encoder(path), {}
        self.mark = {m: self.encode([m])[0] for m in ".,"} | {"": b""}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(chunks, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn_letters(self, runs: list[str]) -> None:
        found = self.letters.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            self.known.update(zip(runs, self.encode(runs), strict=True))
            return
        whole, at = ids.tobytes(), (4 * ends).tolist()
        self.known.update(zip(runs, map(whole.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))

    def learn(self, chunks: Iterable[str]) -> None:
        known, words, marked, rest = self.known, [], [], []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                words.append(chunk)
            elif found := LETTERS.fullmatch(chunk):
                marked.append((chunk, found[1].lower(), found[2]))
            else:
                rest.append(chunk)
        lower = " ".join(words).lower().split(" ") if words else []
        runs = list({*lower, *(run for _, run, _ in marked)}.difference(known))
        for k in range(0, len(runs), 5000):
            self.learn_letters(runs[k : k + 5000])
        known.update(zip(words, map(known.__getitem__, lower), strict=True))
        for chunk, run, mark in marked:
            known[chunk] = known[run] + self.mark[mark]
        for k in range(0, len(rest), 5000):
            known.update(zip(rest[k : k + 5000], self.encode(rest[k : k + 5000]), strict=True))

    def of(self, texts: list[str]) -> list[bytes]:
        # str.split also cuts at four control characters that the tokenizer keeps
        split = [t.split(" ") if any(c in t for c in CONTROLS) else t.split() for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        self.learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]


class PlainIds:
    """Ids of texts as the tokenizer gives them, text by text."""

    def __init__(self, path: str):
        self.tokenizer = _encoder(path)

    def of(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


#: Texts on which the memory of chunks must agree with the tokenizer, or it isn't used: words in every case, marks, white
#: space of all kinds, letters beyond ASCII, digits, markup and control characters.
PROBES = (
    "The pump, the PUMP and the Pump. Pump.x 12.5 a,b", "  two  spaces\tand\n\nlines \r\n", "Ünïcode straße Éa ÉCOLE ñandú œuvre",
    "don't e-mail x_y <b>bold</b> #tag @me (a) [b] {c} 100% a/b", "日本語 текст हिन्दी عربى 한국", "\x1ca\x1fb\x00c\u00a0d\u200be", "", ".", "a" * 300,
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids | PlainIds:
    """The memory of chunks where the tokenizer file has the rules it is made for, else the tokenizer alone."""
    plain = PlainIds(path)
    try:
        fast = Ids(path)
        same = fast.of(list(PROBES)) == plain.of(list(PROBES))
    except (IndexError, KeyError, ValueError):
        same = False
    return Ids(path) if same else plain


def pieces_of(path: str, room: int, with_ids: bool):
    """A function over Arrow batches (body, ...): the other columns, once for each piece of the document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], dtype="<u4").tobytes()
        ids = _ids(path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                row, piece, start, length, crc, lists = [], [], [], [], [], []
                for i, found in enumerate(ids.of(part.column("body").to_pylist())):
                    found += end
                    for n, at in enumerate(range(0, len(found), 4 * room)):
                        own = found[at : at + 4 * room]
                        row.append(i)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            lists.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                kept = [f for f in part.schema.names if f != "body"]
                columns = [part.column(f).take(pa.array(row, pa.int64())) for f in kept]
                columns += [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = [*kept, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def exact_patterns(lengths: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[int, ...]]:
    """Patterns of one to three occurring lengths that fill `room` exactly. For each first length, THIRDS second lengths
    spread over the quantiles of the pieces that still fit are tried."""
    there = set(lengths.tolist())
    total = np.cumsum(counts)
    out = set()
    for a in lengths.tolist():
        if a == room:
            out.add((a,))
            continue
        if room - a in there:
            out.add(tuple(sorted((a, room - a))))
        upto = int(np.searchsorted(lengths, room - a, "left"))
        if not upto:
            continue
        marks = (np.arange(THIRDS) + 0.5) / THIRDS * total[upto - 1]
        for b in lengths[np.minimum(np.searchsorted(total, marks), upto - 1)].tolist():
            # the nearest third length that completes the sequence
            c = room - a - b
            if c in there:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def fit(patterns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths nearest to the counts: accelerated projected gradient."""
    at = {n: i for i, n in enumerate(lengths.tolist())}
    rows = np.array([at[n] for p in patterns for n in p])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    n_rows, n_cols = len(lengths), len(patterns)
    x = y = np.zeros(n_cols)
    goal = counts.astype(float)
    # scaled by how crowded a pattern's lengths are, which bounds the curvature
    crowd = np.bincount(rows, minlength=n_rows)
    step = 1.0 / np.maximum(1, np.bincount(cols, crowd[rows] * 1.0, minlength=n_cols))
    t = 1.0
    for _ in range(ROUNDS):
        miss = np.bincount(rows, y[cols], minlength=n_rows) - goal
        new = np.maximum(0.0, y - step * np.bincount(cols, miss[rows], minlength=n_cols))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit(counts: dict[int, int], room: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit-decreasing on counts: groups ((length, times), ...) of equal sequences, and how many there are of each."""
    open_groups: dict[int, list] = {}
    spaces: list[int] = []

    def put(space: int, group: tuple, n: int) -> None:
        if space not in open_groups:
            open_groups[space] = []
            bisect.insort(spaces, space)
        open_groups[space].append((group, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        added = []
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                break
            space = spaces[i]
            group, n = open_groups[space].pop()
            if not open_groups[space]:
                del open_groups[space], spaces[i]
            times = min(space // length, left)
            used = min(n, left // times)
            if n > used:
                put(space, group, n - used)
            left -= used * times
            added.append((space - times * length, (*group, (length, times)), used))
        if left:
            times = room // length
            if left // times:
                added.append((room - times * length, ((length, times),), left // times))
            if left % times:
                added.append((room - left % times * length, ((length, left % times),), 1))
        for item in added:
            put(*item)
    return [g for groups in open_groups.values() for g in groups]


def plan(counts: dict[int, int], room: int = ROOM) -> tuple[np.ndarray, int]:
    """Rows (length, first number, times a sequence, first sequence, offset) sorted by the first two, and the number of
    sequences: the piece of `length` numbered r lies in the last row whose first number is not above r."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return np.zeros((0, 5), dtype=np.int64), 0
    lengths = np.array(sorted(counts))
    totals = np.array([counts[n] for n in lengths.tolist()])
    chosen: list[tuple[tuple[tuple[int, int], ...], int]] = []
    left = dict(counts)
    patterns = exact_patterns(lengths, totals, room)
    if patterns:
        repeats = fit(patterns, lengths, totals)
        for i in np.argsort(-repeats, kind="stable").tolist():
            runs = tuple((n, patterns[i].count(n)) for n in sorted(set(patterns[i]), reverse=True))
            n = min(int(repeats[i] + 1e-9), *(left[a] // m for a, m in runs))
            if n:
                chosen.append((runs, n))
                for a, m in runs:
                    left[a] -= n * m
    chosen += best_fit({n: c for n, c in left.items() if c}, room)
    taken = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for runs, n in chosen:
        offset = 0
        for length, times in runs:
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += n * times
            offset += length * times
        sequence += n
    assert taken == counts, "every piece has its place"
    return np.array(sorted(rows), dtype=np.int64), sequence


def _placed(rows: np.ndarray):
    """A function over Arrow batches (length, number, ...) that adds sequence_id and offset."""
    high = 1 << 40

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = rows[:, 0] * high + rows[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            own = rows[np.searchsorted(keys, length * high + number, "right") - 1]
            inside = number - own[:, 1]
            sequence, offset = own[:, 3] + inside // own[:, 2], own[:, 4] + inside % own[:, 2] * length
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    return look


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    text: str = "text",
    doc_id: str = "doc_id",
    room: int = ROOM,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and `ids`, the tokens).

    A document's ids are those of the tokenizer file at `tokenizer`, whatever its kind, then the end id; only documents
    longer than `room` are cut. Null texts count as empty, so they are a piece of one token. Null ids and rows that repeat an id are packed
    like any others, each in a place of its own. A text is held whole in one worker; tables that are empty give no
    rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    schema = rows.drop("body").schema.add("piece", T.IntegerType())
    for name in ("start", "length", "ids_crc32"):
        schema.add(name, T.LongType())
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    found = materialise(rows.mapInArrow(pieces_of(tokenizer, room, with_ids), schema))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table, _ = plan(counts, room)
    buckets = max(LEAST_BUCKETS, max(counts.values(), default=0) // BUCKET_ROWS)
    # any order of the pieces of a length will do; by row, so that equal rows are dealt out like all others
    numbered = found.withColumn("row__no", F.monotonically_increasing_id())
    numbered = numbered.withColumns({"bucket": F.pmod(F.xxhash64("row__no"), F.lit(buckets)), "one": F.lit(1)})
    numbered = running(numbered, ["length"], "bucket", ["row__no"], {"number": "one"})
    numbered = numbered.select(*found.columns, (F.col("number") - 1).alias("number"))
    full = T.StructType([*found.schema.fields]).add("sequence_id", T.LongType()).add("offset", T.LongType())
    return numbered.mapInArrow(_placed(table), full)
