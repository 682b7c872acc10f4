"""Secret scans by grammar inference.

Three fixed patterns find credentials and label them with their kind. From all distinct values of each kind a prefix tree
is built, and its states are merged where their futures are statistically compatible (Hoeffding's bound on
every transition and on the end, followed through the common continuations): the result is a probabilistic automaton of
the kind's format. Another automaton is learned in the same way from runs of characters that no pattern finds. All such
runs of all texts are then scored: the mean logarithm of how much likelier a kind's automaton makes the run than the
ordinary one. Runs above the kind's threshold, and about as likely under its automaton as credentials are, are added to
the credentials that the patterns find.

The tree is never held whole. All values go through the states settled so far; what follows where they leave them is
counted in Spark, prefix by prefix, and merged in one task; then the values go on from there, until none leaves any more.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borewatch.llm.common import carried, materialise
from borewatch.operators.quantiles import exact_quantiles
from borewatch.session import ship_package

KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
#: Characters of values; all are ASCII, so bytes can be looked at.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Fewer values of a kind teach nothing.
LEAST_VALUES = 20
#: Symbols that tests look ahead from where values leave the settled states. Of the values that leave them in a round,
#: continuations of fewer than one in RESOLVED are counted into their state and not tested apart. All values go on.
LOOKAHEAD, RESOLVED = 64, 20_000
#: So few values go on one by one.
FEW = 16
#: Shortest run that is scored.
CANDIDATE = 12
#: Error allowed to a test of two states, most states of an automaton, and what unseen transitions count as.
ALPHA, STATES, SMOOTH = 0.05, 64, 0.1
#: Shares of held-out credentials below, and of held-out ordinary runs above, what a threshold should separate.
MISSED, FALSE = 0.02, 0.001
#: How much less likely a symbol may be, on average, than in the least likely credentials.
SLACK = 0.2
#: Bytes of texts looked at together.
BATCH = 4 << 20

CODE = np.full(256, -1, dtype=np.int64)
CODE[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(len(ALPHABET))
IS_VALUE = CODE >= 0
IS_HEX = np.zeros(256, dtype=bool)
IS_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = True
STOP = len(ALPHABET)


@dataclass
class Automaton:
    """Deterministic probabilistic automaton: next state and log-probability of each symbol, the end being the last."""

    follow: np.ndarray
    log_p: np.ndarray

    def scores(self, values: list[bytes]) -> np.ndarray:
        """Log-probability of each value, all advanced together, longest first."""
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        codes = CODE[np.frombuffer(b"".join(values), dtype=np.uint8)]
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order] if len(values) else sizes
        longest = sizes[order]
        state, total = np.zeros(len(values), dtype=np.int64), np.zeros(len(values))
        for at in range(int(longest[0]) if len(values) else 0):
            n = int(np.searchsorted(-longest, -at, side="left"))
            if n <= FEW and longest[0] - at > LOOKAHEAD:
                self._go_on(n, at, codes, first, longest, state, total)
                break
            symbol = codes[first[:n] + at]
            total[:n] += self.log_p[state[:n], symbol]
            state[:n] = self.follow[state[:n], symbol]
        total += self.log_p[state, STOP]
        out = np.empty(len(values))
        out[order] = total
        return out

    def _go_on(self, n, at, codes, first, longest, state, total) -> None:
        """Bring the first n values, from symbol `at` on, to their ends."""
        follow, log_p = self.follow.tolist(), self.log_p.tolist()
        for i in range(n):
            here, so_far = int(state[i]), float(total[i])
            for symbol in codes[first[i] + at : first[i] + longest[i]].tolist():
                so_far += log_p[here][symbol]
                here = follow[here][symbol]
            state[i], total[i] = here, so_far


class _States:
    """A prefix tree whose states are merged step by step."""

    def __init__(self, values: list[bytes]):
        self.visits, self.stops, self.kids, self.out = [0], [0], [{}], [{}]
        for value in values:
            at = 0
            self.visits[0] += 1
            for symbol in CODE[np.frombuffer(value, dtype=np.uint8)].tolist():
                kid = self.kids[at].get(symbol)
                if kid is None:
                    kid = self.kids[at][symbol] = len(self.visits)
                    for column, empty in ((self.visits, 0), (self.stops, 0), (self.kids, {}), (self.out, {})):
                        column.append(empty)
                self.out[at][symbol] = self.out[at].get(symbol, 0) + 1
                at = kid
                self.visits[at] += 1
            self.stops[at] += 1

    @classmethod
    def counted(cls, follow: np.ndarray, rows: list[tuple[int, str, str, int]]) -> _States:
        """Settled states, which come first, and the trees behind them, from rows (state, path from there, next symbol or
        none at the end, how often)."""
        tree = cls([])
        tree.visits, tree.stops = [0] * len(follow), [0] * len(follow)
        tree.kids = [{s: int(k) for s, k in enumerate(row) if k >= 0} for row in follow]
        tree.out = [{} for _ in follow]
        places: dict[tuple[int, str], int] = {(state, ""): state for state in range(len(follow))}
        for state, path, symbol, n in sorted(rows):
            at = places.get((state, path))
            if at is None:
                at = places[state, path] = len(tree.visits)
                for column, empty in ((tree.visits, 0), (tree.stops, 0), (tree.kids, {}), (tree.out, {})):
                    column.append(empty)
                # shorter paths of the tree are at least as frequent, and sort before
                tree.kids[places[state, path[:-1]]][int(CODE[ord(path[-1])])] = at
            tree.visits[at] += n
            if symbol:
                code = int(CODE[ord(symbol)])
                tree.out[at][code] = tree.out[at].get(code, 0) + n
            else:
                tree.stops[at] += n
        return tree

    def compatible(self, a: int, b: int) -> bool:
        """Whether nothing seen after the two states tells them apart; b is the root of a tree."""
        n, m = self.visits[a], self.visits[b]
        if m < 3 or n < 3:
            return True
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(self.stops[a] / n - self.stops[b] / m) > bound:
            return False
        for symbol in self.out[a].keys() | self.out[b].keys():
            if abs(self.out[a].get(symbol, 0) / n - self.out[b].get(symbol, 0) / m) > bound:
                return False
        return all(
            self.compatible(self.kids[a][s], kid) for s, kid in self.kids[b].items() if s in self.kids[a]
        )

    def likeness(self, a: int, b: int) -> float:
        """Log-probability, under state a, of what was seen at state b."""
        whole = self.visits[a] + SMOOTH * (STOP + 1)
        seen = sum(k * math.log((self.out[a].get(s, 0) + SMOOTH) / whole) for s, k in sorted(self.out[b].items()))
        return seen + self.stops[b] * math.log((self.stops[a] + SMOOTH) / whole)

    def fold(self, a: int, b: int) -> None:
        """Add state b, the root of a tree, and what follows it to state a."""
        work = [(a, b)]
        while work:
            a, b = work.pop()
            self.visits[a] += self.visits[b]
            self.stops[a] += self.stops[b]
            for symbol, k in self.out[b].items():
                self.out[a][symbol] = self.out[a].get(symbol, 0) + k
            for symbol, kid in self.kids[b].items():
                if symbol in self.kids[a]:
                    work.append((self.kids[a][symbol], kid))
                else:
                    self.kids[a][symbol] = kid


def merge(tree: _States, settled: dict[int, int]) -> None:
    """Settle or merge all states that settled ones lead to.

    They are taken in order of their visits. Each is merged with the compatible settled
    state that makes its continuations likeliest, or is settled itself; beyond STATES settled ones it is merged anyway.
    """
    while True:
        edges = [(tree.visits[k], -k, s, r) for r in settled for s, k in tree.kids[r].items() if k not in settled]
        if not edges:
            break
        _, kid, symbol, parent = max(edges)
        kid = -kid
        fitting = [r for r in settled if tree.compatible(r, kid)]
        if not fitting and len(settled) < STATES:
            settled[kid] = len(settled)
            continue
        best = max(fitting or settled, key=lambda r: (tree.likeness(r, kid), -settled[r]))
        tree.kids[parent][symbol] = best
        tree.fold(best, kid)


def _follow(tree: _States, settled: dict[int, int]) -> np.ndarray:
    """The state that each symbol leads to, -1 where none is known."""
    follow = np.full((len(settled), STOP), -1, dtype=np.int64)
    for state, row in settled.items():
        for symbol, kid in tree.kids[state].items():
            follow[row, symbol] = settled[kid]
    return follow


def _automaton(follow: np.ndarray, counts: np.ndarray) -> Automaton:
    p = counts + SMOOTH
    return Automaton(np.maximum(follow, 0), np.log(p / p.sum(axis=1, keepdims=True)))


def learn(values: list[bytes]) -> Automaton:
    """The automaton of a list of values."""
    tree, settled = _States(sorted(values)), {0: 0}
    merge(tree, settled)
    counts = np.zeros((len(settled), STOP + 1))
    for state, row in settled.items():
        for symbol, k in tree.out[state].items():
            counts[row, symbol] = k
        counts[row, STOP] = tree.stops[state]
    return _automaton(_follow(tree, settled), counts)


@dataclass
class Formats:
    """Automata of the kinds and of ordinary runs; the least score of each kind, and the least likelihood itself."""

    automata: dict[str, Automaton]
    thresholds: dict[str, float]
    floors: dict[str, float]

    def likelihood(self, kind: str, values: list[bytes]) -> np.ndarray:
        """Mean log-probability of a symbol, the end included."""
        return self.automata[kind].scores(values) / np.array([len(v) + 1 for v in values])

    def separate(self, kind: str, low: float, high: float, likely: float) -> None:
        """Set a kind's limits: `low` is the score that few credentials miss, `high` the one that few ordinary runs reach,
        `likely` the likelihood that few credentials miss."""
        self.thresholds[kind], self.floors[kind] = max((low + high) / 2, high), likely - SLACK

    def judge(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the kind that fits with the best score (-1: none does), and that score."""
        kind, best = np.full(len(values), -1), np.full(len(values), -np.inf)
        ordinary = self.likelihood(ORDINARY, values) if self.thresholds else None
        for i, name in enumerate(KINDS):
            if name in self.thresholds:
                likely = self.likelihood(name, values)
                score = likely - ordinary
                better = (score >= self.thresholds[name]) & (likely >= self.floors[name]) & (score > best)
                kind[better], best[better] = i, score[better]
        return kind, best


def infer(lists: dict[str, list[bytes]]) -> Formats:
    """Automata from four fifths of each list (by a hash of the value), thresholds from the rest: what `learned` does with
    values that one task can hold."""
    lists = {k: sorted(set(v)) for k, v in lists.items()}
    held = {k: [v for v in vs if zlib.crc32(v) % 5 == 0] or vs for k, vs in lists.items()}
    known = {k: [v for v in vs if zlib.crc32(v) % 5] or vs for k, vs in lists.items()}
    some = [k for k in KINDS if len(lists.get(k, [])) >= LEAST_VALUES]
    if not some or len(lists.get(ORDINARY, [])) < LEAST_VALUES:
        return Formats({}, {}, {})
    formats = Formats({k: learn(known[k]) for k in [*some, ORDINARY]}, {}, {})
    for kind in some:
        likely, other = formats.likelihood(kind, held[kind]), formats.likelihood(kind, held[ORDINARY])
        low = float(np.quantile(likely - formats.likelihood(ORDINARY, held[kind]), MISSED))
        high = float(np.quantile(other - formats.likelihood(ORDINARY, held[ORDINARY]), 1 - FALSE))
        formats.separate(kind, low, high, float(np.quantile(likely, MISSED)))
    return formats


@dataclass
class Found:
    """Places in the joined bytes of some texts: base matches (kind, start, end, value) and runs that they leave."""

    data: bytes
    base: list[tuple[int, int, int, bytes]]
    runs: list[tuple[int, int]]


def search(data: bytes) -> Found:
    """Base matches and other runs of at least CANDIDATE characters, without dots at their ends."""
    base = []
    lower = data.lower()
    places = []
    for word in WORDS:
        at = lower.find(word)
        while at >= 0:
            places.append(at)
            at = lower.find(word, at + 1)
    end = 0
    for at in sorted(places):
        found = ASSIGN.match(data, at) if at >= end else None
        if found:
            end = found.end()
            if len(found[2]) >= LEAST_ASSIGN:
                base.append((0, found.start(), end, found[2]))
    for found in ACCESS.finditer(data):
        if len(found[0]) >= LEAST_ACCESS:
            base.append((1, found.start(), found.end(), found[0]))
    array = np.frombuffer(data, dtype=np.uint8)
    for start, end in zip(*_runs(IS_HEX[array], LEAST_HEX)):
        base.append((2, start, end, data[start:end]))
    taken = _union([(b[1], b[2]) for b in base])
    lefts, rights = np.array([t[0] for t in taken], dtype=np.int64), np.array([t[1] for t in taken], dtype=np.int64)
    starts, ends = _runs(IS_VALUE[array], CANDIDATE)
    if len(taken) and len(starts):
        # the first base match that ends behind the run's start must begin behind its end
        at = np.searchsorted(rights, starts, side="right")
        free = lefts[np.minimum(at, len(lefts) - 1)] >= ends
        free |= at == len(lefts)
        starts, ends = starts[free], ends[free]
    runs = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        while end > start and data[end - 1] == 46:
            end -= 1
        while start < end and data[start] == 46:
            start += 1
        if end - start >= CANDIDATE:
            runs.append((start, end))
    return Found(data, base, runs)


def _runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return starts[long], ends[long]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH bytes; a longer text is a group of its own and is never cut."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > BATCH:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def _values_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of each kind and ordinary runs, once for each group of texts."""
    for batch in batches:
        texts = batch.column("body").to_pylist()
        for a, b in _groups(texts):
            found = search(b"\n".join(texts[a:b]))
            seen = {(KINDS[k], v) for k, _, _, v in found.base} | {(ORDINARY, found.data[s:e]) for s, e in found.runs}
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.string()), pa.array([v.decode() for _, v in seen], pa.string())],
                ["kind", "value"],
            )


def _walk(values: list[bytes], follow: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """Bring values through settled states, counting the symbols and ends they pass; (value, state, place) of those that
    leave them."""
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    codes = CODE[np.frombuffer(b"".join(values), dtype=np.uint8)]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    state, left, at = np.zeros(len(values), dtype=np.int64), [], 0
    while len(order) > FEW:
        n = int(np.searchsorted(-sizes[order], -at, side="left"))
        np.add.at(counts, (state[order[n:]], STOP), 1)
        order = order[:n]
        symbol = codes[first[order] + at]
        to = follow[state[order], symbol]
        gone, on = order[to < 0], order[to >= 0]
        left += zip(gone.tolist(), state[gone].tolist(), [at] * len(gone))
        np.add.at(counts, (state[on], symbol[to >= 0]), 1)
        state[on] = to[to >= 0]
        order, at = on, at + 1
    table = follow.tolist()
    for i in order.tolist():
        here, passed = int(state[i]), {}
        for place, symbol in enumerate(codes[first[i] + at : first[i] + sizes[i]].tolist(), at):
            to = table[here][symbol]
            if to < 0:
                left.append((i, here, place))
                break
            passed[here, symbol] = passed.get((here, symbol), 0) + 1
            here = to
        else:
            counts[here, STOP] += 1
        for (where, symbol), n in passed.items():
            counts[where, symbol] += n
    return left


WALKED = "kind string, state int, inside boolean, word string, ended boolean, n long"


def _walk_in_task(machines: dict[str, np.ndarray]):
    """Rows WALKED: the symbols passed inside settled states (empty at the end), counted, and for every value that leaves
    them what follows, LOOKAHEAD symbols and one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.int64())
            names = [c.split()[0] for c in WALKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        counts = {k: np.zeros((len(follow), STOP + 1), dtype=np.int64) for k, follow in machines.items()}
        for batch in batches:
            of_kind: dict[str, list[bytes]] = {}
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()):
                of_kind.setdefault(kind, []).append(value.encode())
            for kind, values in of_kind.items():
                left = _walk(values, machines[kind], counts[kind])
                yield table([
                    (kind, state, False, values[i][at : at + LOOKAHEAD + 1].decode(), len(values[i]) - at <= LOOKAHEAD, 1)
                    for i, state, at in left
                ])
        symbols = [chr(c) for c in ALPHABET] + [""]
        yield table([
            (kind, int(r), True, symbols[c], None, int(seen[r, c])) for kind, seen in counts.items() for r, c in zip(*np.nonzero(seen))
        ])

    return run


def _merge_in_task(machines: dict[str, np.ndarray]):
    def run(counted: pa.Table) -> pa.Table:
        kind = counted.column("kind")[0].as_py()
        rows = list(zip(*(counted.column(c).to_pylist() for c in ("state", "path", "next", "n"))))
        tree = _States.counted(machines[kind], rows)
        settled = {state: state for state in range(len(machines[kind]))}
        merge(tree, settled)
        follow = _follow(tree, settled).astype("<i8").tobytes()
        return pa.table({"kind": pa.array([kind], pa.string()), "follow": pa.array([follow], pa.binary())})

    return run


def _grown(values: DataFrame, kinds: list[str]) -> dict[str, Automaton]:
    """The automaton of all values (kind, value) of each kind.

    In a round all values go through the states settled so far. What follows where they leave them is counted prefix by
    prefix, and one task for each kind merges these counted trees, of at most RESOLVED paths of each length, into the
    states. A kind is done when no value leaves its states; then every symbol of every value has been counted."""
    machines = {k: np.full((1, STOP), -1, dtype=np.int64) for k in kinds}
    done: dict[str, Automaton] = {}
    while machines:
        some = values.where(F.col("kind").isin(*machines))
        walked = materialise(some.mapInArrow(_walk_in_task(machines), WALKED))
        inside = walked.where("inside").groupBy("kind", "state", F.col("word").alias("next")).agg(F.sum("n").alias("n"))
        left = {r["kind"]: r["n"] for r in walked.where("not inside").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        if len(left) < len(machines):
            counts = {k: np.zeros((len(machines[k]), STOP + 1)) for k in machines if k not in left}
            for r in inside.where(F.col("kind").isin(*counts)).collect():  # one row a symbol of a settled state
                counts[r["kind"]][r["state"], CODE[ord(r["next"])] if r["next"] else STOP] = r["n"]
            for kind, seen in counts.items():
                done[kind] = _automaton(machines.pop(kind), seen)
        if not machines:
            break
        least = F.element_at(F.create_map(*(F.lit(x) for k, n in left.items() for x in (k, -(-n // RESOLVED)))), F.col("kind"))
        upto = F.length("word") - F.when(F.col("ended"), 0).otherwise(1)
        nodes = (
            walked.where("not inside")
            .select("kind", "state", "word", "n", F.explode(F.sequence(F.lit(0), upto)).alias("d"))
            .groupBy("kind", "state", F.expr("substring(word, 1, d)").alias("path"), F.expr("substring(word, d + 1, 1)").alias("next"))
            .agg(F.sum("n").alias("n"))
            .groupBy("kind", "state", "path")
            .agg(F.sum("n").alias("visits"), F.collect_list(F.struct("next", "n")).alias("out"))
            .where((F.col("visits") >= least) | (F.length("path") <= 1))
            .select("kind", "state", "path", F.inline("out"))
        )
        counted = nodes.unionByName(inside.where(F.col("kind").isin(*machines)).select("kind", "state", F.lit("").alias("path"), "next", "n"))
        merged = counted.groupBy("kind").applyInArrow(_merge_in_task(machines), "kind string, follow binary")
        for r in merged.collect():  # at most STATES states of each kind
            machines[r["kind"]] = np.frombuffer(r["follow"], dtype="<i8").reshape(-1, STOP)
    return done


def _rate_in_task(formats: Formats, kinds: list[str]):
    """How likely held-out values are: of credentials `low` (against ordinary runs) and `likely`, of ordinary runs `high`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_kind: dict[str, list[bytes]] = {}
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()):
                of_kind.setdefault(kind, []).append(value.encode())
            for own, values in of_kind.items():
                ordinary = formats.likelihood(ORDINARY, values)
                for kind in kinds if own == ORDINARY else [own]:
                    likely = formats.likelihood(kind, values)
                    rates = {"high": likely - ordinary} if own == ORDINARY else {"low": likely - ordinary, "likely": likely}
                    for name, rate in rates.items():
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{kind} {name}"] * len(rate), pa.string()), pa.array(rate, pa.float64())], ["of", "rate"]
                        )

    return run


def learned(docs: DataFrame, *, text: str = "text") -> Formats:
    """Formats learned from the credentials that the patterns find in all texts, and from all ordinary runs: automata from
    four fifths of the distinct values of each kind (by a hash of the value), thresholds from the rest. A kind with fewer
    than LEAST_VALUES values is not learned."""
    ship_package(docs.sparkSession)
    bodies = docs.select(F.encode(F.col(text).cast("string"), "UTF-8").alias("body")).where("body is not null")
    held = (F.crc32(F.col("value").cast("binary")) % 5 == 0).alias("held")
    values = materialise(bodies.mapInArrow(_values_in_task, "kind string, value string").distinct().select("*", held))
    sizes = {(r["kind"], r["held"]): r["count"] for r in values.groupBy("kind", "held").count().collect()}
    enough = [k for k in (*KINDS, ORDINARY) if sizes.get((k, True), 0) + sizes.get((k, False), 0) >= LEAST_VALUES]
    kinds = [k for k in enough if k != ORDINARY]
    if not kinds or ORDINARY not in enough:
        return Formats({}, {}, {})

    def side(held: bool) -> DataFrame:
        """Values of one side; all of a kind that has none there."""
        bare = [k for k in enough if (k, held) not in sizes]
        return values.where(F.col("kind").isin(*enough) & ((F.col("held") == held) | F.col("kind").isin(*bare)))

    formats = Formats(_grown(side(False), enough), {}, {})
    rates = materialise(side(True).select("kind", "value").mapInArrow(_rate_in_task(formats, kinds), "of string, rate double"))
    found = exact_quantiles(rates, "rate", ["of"], [MISSED, 1 - FALSE], ["least", "most"])
    limits = {r["of"]: r for r in found.collect()}
    for kind in kinds:
        formats.separate(kind, limits[f"{kind} low"]["least"], limits[f"{kind} high"]["most"], limits[f"{kind} likely"]["least"])
    return formats


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def spans_of(texts: list[bytes], formats: Formats) -> list[tuple[list[tuple], list[tuple]]]:
    """Base and added spans (kind number, start, end, score) of each text, in code points."""
    out: list[tuple[list[tuple], list[tuple]]] = [([], []) for _ in texts]
    for a, b in _groups(texts):
        found = search(b"\n".join(texts[a:b]))
        array = np.frombuffer(found.data, dtype=np.uint8)
        sizes = np.array([len(t) + 1 for t in texts[a:b]], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # characters that begin before each byte
        chars = np.concatenate(([0], np.cumsum((array & 0xC0) != 0x80, dtype=np.int64)))

        def put(side: int, kind: int, start: int, end: int, score) -> None:
            owner = int(np.searchsorted(first, start, side="right")) - 1
            zero = chars[first[owner]]
            out[a + owner][side].append((kind, int(chars[start] - zero), int(chars[end] - zero), score))

        for kind, start, end, _ in found.base:
            put(0, kind, start, end, None)
        if formats.thresholds and found.runs:
            values = [found.data[s:e] for s, e in found.runs]
            distinct = list(dict.fromkeys(values))
            kinds, scores = formats.judge(distinct)
            chosen = {v: (int(k), float(s)) for v, k, s in zip(distinct, kinds, scores) if k >= 0}
            if chosen:
                for value, (start, end) in zip(values, found.runs):
                    if value in chosen:
                        put(1, chosen[value][0], start, end, chosen[value][1])
    for base, added in out:
        base.sort(key=lambda s: (s[1], s[0], s[2]))
        added.sort(key=lambda s: (s[1], s[0], s[2]))
    return out


def _find(formats: Formats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("body").to_pylist()]
            found = spans_of(texts, formats)
            kept = [c for c in batch.schema.names if c != "body"]
            sides = [
                pa.array([[dict(kind=KINDS[k], start=s, end=e, score=x) for k, s, e, x in row[side]] for row in found], pa.list_(SPAN)) for side in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sides], [*kept, "base", "added"])

    return run


def find(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, base, added (and `carried`, the whole row).

    base and added are arrays of (kind, start, end, score) by start, then kind; places are code points, ends exclusive;
    the score of base spans is null. base holds what the patterns find: `assign`, `access` and `hex`, whole matches. added
    holds runs of value characters, of CANDIDATE characters or more and apart from all base spans, whose format is
    likelier to be that of a kind than an ordinary one. Null and empty texts have no spans. Without enough credentials of
    a kind none of it are added. Repeated rows give repeated rows, null ids stay. Empty tables give no rows; other columns
    are not looked at.
    """
    formats = learned(docs, text=text)
    extra = carried(docs)[:1] if carry else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), *extra, F.encode(F.col(text).cast("string"), "UTF-8").alias("body"))
    span = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))
    schema = rows.drop("body").schema.add("base", span).add("added", span)
    return rows.mapInArrow(_find(formats), schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the number of base spans of each kind, the SHA-256 of all base spans, and all spans as text."""
    found = find(docs, **options)
    kinds = F.array(*(F.lit(k) for k in KINDS))

    def order(a: Column, b: Column) -> Column:
        def sign(x, y):
            return F.when(x < y, -1).when(x > y, 1)

        place = sign(F.array_position(kinds, a["kind"]), F.array_position(kinds, b["kind"]))
        return F.coalesce(sign(a["start"], b["start"]), place, sign(a["end"], b["end"]), F.lit(0))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("base", "added"), order)
    return found.select(
        "doc_id", *(number(k) for k in KINDS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.when(F.size("added") == 0, _joined(F.col("base"))).otherwise(_joined(every)).alias("spans"),
    )
