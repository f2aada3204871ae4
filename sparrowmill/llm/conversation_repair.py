"""Conversation structure repair by weighted finite-state composition.

Three machines are composed lazily, arc by arc: the acceptor of a conversation's rows in order, the
transducer of edits, which reads rows and writes roles, and the acceptor of the grammar
``(s?(ua)+)?`` of role initials.  A state of the composition is a row's place and a grammar state, so
that places are a topological order; inserts, which read no row, cost more than nothing and are
relaxed within a place.  Weights are pairs (cost, labels) in lexicographic order, added by taking the
least and multiplied by adding costs and joining labels.  Two paths to one state read the same rows,
so that where one's labels begin the other's, the latter has more inserts and costs more: the least
path to a state stays the least whatever follows.

Rows come sorted and are read batch by batch.  Paths too dear ever to win are dropped; each of the few
that survive has a checksum of what it would write, so that a conversation's texts are not held, only
its labels, a byte a row and path.  What the surviving paths have in common is committed from time to time.
Whether a row repeats an earlier one is found before, by a window over equal rows.  A conversation's
audit and checksum are one value each over all its rows in order, so its rows pass through one task
as a stream; conversations are dealt over all tasks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import shuffle_partitions
from ._arrow import pieces

#: The grammar's arcs: state, role initial read -> state.  0 is the start, 1 after s, 2 after u, 3 after a.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, UNREPAIRED = 0, 1, 2, 5, 5
#: From any state two inserts and a delete, instead of a kept s, make up for having been in any other.
AHEAD = 2 * INSERT + DELETE
WHITE = " \t\n\v\f\r"
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


def edits(initial: str, fault: str | None) -> list[tuple[str, str | None, int]]:
    """Arcs of the edit transducer on a row: label, role initial written or none, cost."""
    arcs = [("D", None, DELETE)]
    if fault not in (BLANK, DUPLICATE):
        more = UNREPAIRED if fault == TRUNCATED else 0
        arcs += [("K", initial, KEEP + more)] if initial else []
        arcs += [("R", role, REROLE + more) for role in ROLES]
    return arcs


def inserts(state: int) -> list[tuple[int, tuple[str, ...]]]:
    """States that up to two inserts reach, each by the fewest, with the roles that they write."""
    found = {state: ()}
    for _ in range(2):
        for (at, role), to in GRAMMAR.items():
            if role in ROLES and at in found and (to not in found or len(found[at]) + 1 < len(found[to])):
                found[to] = (*found[at], role)
    return list(found.items())


INSERTS = {state: inserts(state) for state in range(4)}


class Path:
    """The least path to a grammar state that ends with a row read.

    ``rank`` is its labels' place among those of the other surviving paths; they have read the same rows and
    end with one, so that none begins another, and ranks decide whatever labels follow.  ``chain`` holds the
    labels since the last commit, ``digest`` the checksum of what has been written.
    """

    __slots__ = ("cost", "rank", "chain", "digest", "begun")

    def __init__(self, cost: int, rank: int, chain: tuple, digest, begun: bool):
        self.cost, self.rank, self.chain, self.digest, self.begun = cost, rank, chain, digest, begun

    def written(self, rows: list[tuple[str, str]]) -> tuple:
        """Checksum and whether anything is written, after more rows (role, text)."""
        digest, begun = self.digest, self.begun
        if rows:
            digest = digest.copy()
            for role, text in rows:
                digest.update((("\n" if begun else "") + f"{role}:{text}").encode())
                begun = True
        return digest, begun

    def labels(self) -> str:
        parts, chain = [], self.chain
        while chain:
            parts.append(chain[1])
            chain = chain[0]
        return "".join(reversed(parts))


def step(paths: dict[int, Path], role: str, text: str, fault: str | None) -> dict[int, Path]:
    """The least path to every state once one more row is read, but for those that can't win any more."""
    best: dict[int, tuple] = {}
    for state, path in paths.items():
        for at, new in INSERTS[state]:
            for label, initial, cost in edits(role[:1], fault):
                to = at if initial is None else GRAMMAR.get((at, initial))
                if to is not None:
                    found = (path.cost + INSERT * len(new) + cost, path.rank, "I" * len(new) + label, state, new, initial)
                    if to not in best or found[:3] < best[to][:3]:
                        best[to] = found
    most = min(x[0] for x in best.values()) + AHEAD
    after = {}
    for rank, (to, (cost, _, labels, state, new, initial)) in enumerate(sorted(((t, x) for t, x in best.items() if x[0] <= most), key=lambda x: x[1][1:3])):
        rows = [(ROLES[r], "") for r in new]
        if initial is not None:
            rows.append((role if labels[-1] == "K" else ROLES[initial], text))
        after[to] = Path(cost, rank, (paths[state].chain, labels), *paths[state].written(rows))
    return after


#: Rows after which paths are looked at for what they have in common.
TOGETHER = 256


class Conversation:
    """One conversation as its rows come by: counts, surviving paths, and, if kept, rows not committed yet."""

    def __init__(self, conv_id: int | None, keep: bool):
        self.conv_id, self.keep = conv_id, keep
        self.paths = {0: Path(0, 0, (), hashlib.sha256(), False)}
        self.rows: deque[tuple[int | None, str, str]] = deque()
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, "illegal"), 0)
        self.least = self.most = self.before = self.last = None
        self.turns = self.read = 0
        self.audit: list[str] = []
        self.state, self.at = 0, 0
        self.repaired: list[tuple] = []

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.turns += self.last != turn
            self.least = turn if self.least is None else self.least
            self.most = self.last = turn
        if self.before is not None and self.before[:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = role
        if fault:
            self.counts[fault] += 1
        if self.keep:
            self.rows.append((turn, role, text))
        self.paths = step(self.paths, role, text, fault)
        self.read += 1
        if self.read % TOGETHER == 0:
            found = {state: path.labels() for state, path in self.paths.items()}
            same = commonprefix(list(found.values()))
            self.commit(same)
            for state, path in self.paths.items():
                path.chain = ((), found[state][len(same) :])

    def commit(self, labels: str) -> None:
        """Write out what all surviving paths begin with; each label's role follows from the grammar."""
        self.audit.append(labels)
        for label in labels if self.keep else "":
            turn, role, text = (None, "", "") if label == "I" else self.rows.popleft()
            if label != "D":
                initial = role[:1] if label == "K" else next(r for r in ROLES if (self.state, r) in GRAMMAR)
                self.state = GRAMMAR[self.state, initial]
                role = role if label == "K" else ROLES[initial]
            self.repaired.append((self.conv_id, self.at, label, turn, role, text))
            self.at += 1

    def end(self) -> tuple:
        """The report of the whole conversation."""
        ends = [(path.cost + INSERT * len(new), path.rank, "I" * len(new), state, new) for state, path in self.paths.items() for at, new in INSERTS[state] if at in ACCEPTING]
        cost, _, labels, state, new = min(ends)
        path = self.paths[state]
        self.commit(path.labels() + labels)
        digest, _ = path.written([(ROLES[r], "") for r in new])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), cost, "".join(self.audit), digest.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, at long, edit string, turn long, role string, text string"


def faults(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, ``__fault``: blank, duplicate, truncated or null.

    A row is a duplicate if an earlier row of the conversation has its role and text.  Rows of one turn
    stand by role and text, so that equal rows of one turn are neighbours; ``__gone`` rows don't count.
    """
    same = Window.partitionBy("conv_id", "__gone", "role", "__digest").orderBy(F.col("turn").asc_nulls_first())
    end = F.rtrim("text", F.lit(WHITE))
    fault = F.when(F.length(end) == 0, BLANK).when(F.col("__nth") > 1, DUPLICATE).when(~F.substring(end, -1, 1).isin(".", "!", "?"), TRUNCATED)
    return rows.withColumn("__digest", F.sha2("text", 256)).withColumn("__nth", F.row_number().over(same)).withColumn("__fault", F.when(~F.col("__gone"), fault))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a damage that depends on ``conv_id`` and ``turn`` leaves them; ``__gone`` marks dropped ones.

    Nulls count as one space.  By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its ``.``, ``!`` and ``?`` out, 3 repeats it in the same turn, 4 makes it the user's.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    now = rows.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h <= 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (h == 0).alias("__gone"), F.when(h == 3, 2).otherwise(1).alias("__times"),
    )
    return now.select("conv_id", "turn", "role", "text", "__gone", F.explode(F.sequence(F.lit(1), "__times")).alias("__copy"))


def _streamed(rows: DataFrame, keep: bool) -> DataFrame:
    """All conversations, each as one stream of rows in order."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in (REPAIRED if keep else REPORT).split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in (REPAIRED if keep else REPORT).split(", ")]
        now: Conversation | None = None
        for part in pieces(batches):
            out: list[tuple] = []
            for conv_id, turn, role, text, gone, fault in zip(*[part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "__gone", "__fault")]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        report = now.end()
                        out += now.repaired if keep else [report]
                    now = Conversation(conv_id, keep)
                if not gone:
                    now.add(turn, role, text, fault)
            if keep and now is not None:
                out += now.repaired
                now.repaired = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        if now is not None:
            report = now.end()
            out = now.repaired if keep else [report]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    spread = rows.select("conv_id", "turn", "role", "text", "__gone", "__fault").repartition(2 * shuffle_partitions(rows.sparkSession), "conv_id")
    return spread.sortWithinPartitions("conv_id", *order).mapInArrow(repair, REPAIRED if keep else REPORT)


def _plain(rows: DataFrame) -> DataFrame:
    """Conversations as they are, nulls as one space."""
    return rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("__gone"))


def repair_report(rows: DataFrame, damage: bool = False) -> DataFrame:
    """A row per ``conv_id``: its gaps, faults, illegal neighbours, and the cost, audit and checksum of its repair.

    Rows stand by turn, nulls first; those of one turn by role and text.  Rows of a null ``conv_id``
    are one conversation; null roles and texts count as one space.  A role without a first letter can't
    be kept.  Conversations without rows left have zeros, an empty audit and the checksum of nothing.
    An empty table gives no rows.  Other columns are left alone.
    """
    return _streamed(faults(damaged(rows) if damage else _plain(rows)), keep=False)


def repaired_turns(rows: DataFrame, damage: bool = False) -> DataFrame:
    """The repaired conversations: each edit in order, ``at`` 0 and up, with the turn, role and text it leaves.

    Deleted rows (``edit`` D) are listed with what they had; inserted ones have no turn and no text.
    """
    return _streamed(faults(damaged(rows) if damage else _plain(rows)), keep=True)
