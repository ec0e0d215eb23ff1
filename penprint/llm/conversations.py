"""Repair of conversation structure by the cheapest edits.

A conversation is well formed if the initials of its roles, in turn order, read ``(s?(ua)+)?``. A row is *blank*
without a character other than ASCII white space, a *duplicate* if its role and text were seen earlier in the
conversation, *truncated* if its last such character is none of ``.!?``; its first fault counts. Edits:

    K  keep                                          0, and 3 for a truncated row
    R  change the role to user or assistant          3, and 3 for a truncated row
    D  delete                                        4, the only edit of blank rows and duplicates
    I  insert an empty user or assistant row         3, anywhere

The cheapest edits are a shortest path in the lattice of rows passed and grammar states. It is searched from both
ends (``cheapest``): a forward and a reverse heap meet, every crossing of equal cost is finished, and of the
concatenated audits the least is taken. Two audits of equal cost between the same two nodes are never a prefix
of one another, since the letters alone give the cost, so the least audit is made of least parts.

Rows of a conversation are streamed in turn order through one task, because its SHA-256 can only be made in
order; sorting spills. Memory stays bounded: rows are taken in segments, the cheapest edits of a segment are found
for each pair of grammar states, and four open paths are carried on, each with its own digest. Only the audit
grows with the conversation, as the result does.

Defined results: a null role or text is one space, also a null id or turn in the key of the damage; rows without a
turn come first; rows of one turn follow each other by role and text; repeated rows are duplicates; a null ``conv_id``
is a conversation; roles other than system, user and assistant can be rerolled or deleted; texts of any length are
read whole; a conversation without rows after the damage gives zeros, an empty audit and the digest of nothing; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.bpe import bounded_batches
from penprint.llm.common import same, table

SEGMENT_ROWS, SEGMENT_CHARS = 256, 4_000_000
MEMO = 50_000

# Grammar states: nothing yet, after s, after u, after a. The first and the last may end a conversation.
START, ENDS = 0, (0, 3)
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MUST_GO = "-"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL_PAIRS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

FIGURES = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


# ---------------------------------------------------------------------------------------------------- the search


def _row_edits(code: str) -> list[tuple[int, str, str]]:
    """``cost, letter, initial`` of the edits of a row; a deletion has no initial."""
    edits = [(DELETE, "D", "")]
    if code != MUST_GO:
        extra = TRUNCATED if code.isupper() else 0
        edits.append((extra, "K", code.lower()))
        edits += [(REROLE + extra, "R", role) for role in ROLES]
    return edits


@lru_cache(maxsize=None)
def _ways(code: str) -> tuple[dict, dict]:
    """Edges over a row of this code, by the state before and by the state after: ``cost, letter, other state``."""
    ahead: dict[int, list] = {q: [] for q in range(4)}
    back: dict[int, list] = {q: [] for q in range(4)}
    for q in range(4):
        for cost, letter, initial in _row_edits(code):
            to = STEPS.get((q, initial)) if initial else q
            if to is not None:
                ahead[q].append((cost, letter, to))
                back[to].append((cost, letter, q))
    return ahead, back


_INSERTS = [(q, to) for (q, initial), to in STEPS.items() if initial in ROLES]


def _ahead(codes: str, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    i, q = node
    yield from ((INSERT, "I", (i, to)) for at, to in _INSERTS if at == q)
    if i < len(codes):
        yield from ((cost, letter, (i + 1, to)) for cost, letter, to in _ways(codes[i])[0][q])


def _back(codes: str, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    i, q = node
    yield from ((INSERT, "I", (i, at)) for at, to in _INSERTS if to == q)
    if i:
        yield from ((cost, letter, (i - 1, to)) for cost, letter, to in _ways(codes[i - 1])[1][q])


@lru_cache(maxsize=MEMO)
def cheapest(codes: str, first: int, last: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits from state ``first`` to one of ``last``; None if there are none.

    ``codes`` has a letter per row: the role's initial, ``x`` for other roles, upper case if truncated, ``-`` if
    the row must go. Free edges pass a row, so each side settles equal costs row by row: labels are ordered by
    cost, then rows passed, then audit.
    """
    heaps = [[(0, 0, "", (0, first))], [(0, 0, "", (len(codes), q)) for q in last]]
    settled: list[dict[tuple[int, int], tuple[int, str]]] = [{}, {}]
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1]:
        if best and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, passed, audit, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = cost, audit
        if node in settled[1 - side]:
            best = _better(best, side, (cost, audit), 0, "", settled[1 - side][node])
        for more, letter, to in (_back if side else _ahead)(codes, node):
            if to in settled[1 - side]:
                best = _better(best, side, (cost, audit), more, letter, settled[1 - side][to])
            if to not in settled[side]:
                longer = letter + audit if side else audit + letter
                heappush(heaps[side], (cost + more, passed + (letter != "I"), longer, to))
    return best


def _better(best, side: int, own: tuple[int, str], more: int, letter: str, other: tuple[int, str]) -> tuple[int, str]:
    """The lesser of ``best`` and the crossing from ``own`` over one edge to ``other``."""
    cost = own[0] + more + other[0]
    if best and cost > best[0]:
        return best
    audit = other[1] + letter + own[1] if side else own[1] + letter + other[1]
    return min(best, (cost, audit)) if best else (cost, audit)


def steps_of(audit: str, codes: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """``letter, row, new role`` of every edit: the row is None for inserts, the role None where it stays or goes.

    The letters fix the roles: after a kept system row or at the start comes user, then they alternate.
    """
    row = 0
    for letter in audit:
        initial = codes[row].lower() if letter == "K" else ""
        if letter in "RI":
            initial = "a" if state == 2 else "u"
        yield letter, None if letter == "I" else row, ROLES.get(initial) if letter in "RI" else None
        state = STEPS[state, initial] if initial else state
        row += letter != "I"


class _Path:
    """Edits up to a grammar state: cost, the audit's open end, and the digest of the repaired rows."""

    def __init__(self, cost: int, audit: str, digest, lines: int):
        self.cost, self.audit, self.digest, self.lines = cost, audit, digest, lines

    def longer(self, cost: int, audit: str, segment: list[tuple[str, str, str]], state: int) -> _Path:
        path = _Path(self.cost + cost, self.audit + audit, self.digest.copy(), self.lines)
        codes = "".join(code for code, _, _ in segment)
        for letter, row, role in steps_of(audit, codes, state):
            if letter == "D":
                continue
            _, old_role, text = ("", "", "") if row is None else segment[row]
            line = f"{role or old_role}:{text}"
            path.digest.update((line if path.lines == 0 else "\n" + line).encode("utf-8", "surrogatepass"))
            path.lines += 1
        return path


class _Conversation:
    """The running state of one conversation whose rows come in order."""

    def __init__(self):
        self.faults = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.before = 0, None
        self.turns, self.low, self.high = 0, None, None
        self.segment, self.chars = [], 0
        self.done: list[str] = []
        self.paths = {START: _Path(0, "", hashlib.sha256(), 0)}

    def add(self, turn: int | None, role: str, text: str, code: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL_PAIRS
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.segment.append((code, role, text))
        self.chars += len(text)
        if len(self.segment) >= SEGMENT_ROWS or self.chars >= SEGMENT_CHARS:
            self._advance([(q,) for q in range(4)])

    def _advance(self, goals: list[tuple[int, ...]]) -> None:
        """Carries the open paths over the rows held; one path is kept for each goal."""
        codes = "".join(code for code, _, _ in self.segment)
        paths = {}
        for goal in goals:
            found = []
            for state, path in self.paths.items():
                way = cheapest(codes, state, goal)
                if way:
                    found.append((path.cost + way[0], path.audit + way[1], state, way))
            if found:
                _, _, state, way = min(found)
                paths[goal[0]] = self.paths[state].longer(*way, self.segment, state)
        settled = commonprefix([p.audit for p in paths.values()])  # paths soon share all but their ends
        self.done.append(settled)
        for path in paths.values():
            path.audit = path.audit[len(settled) :]
        self.paths, self.segment, self.chars = paths, [], 0

    def figures(self) -> tuple:
        self._advance([ENDS])
        (path,) = self.paths.values()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        audit = "".join(self.done) + path.audit
        return (gaps, *self.faults.values(), self.illegal, path.cost, audit, path.digest.hexdigest())


# --------------------------------------------------------------------------------------------------------- Spark


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there``: the rows after damage; a dropped row stays with ``there`` false."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode_outer(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), copies.alias("copy"))
    return rows.drop("copy")


def _text_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def diagnose(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` (b, d, t or null) and ``code`` to ``conv_id, turn, role, text, there``, grouped and in turn order.

    The rows are dealt by conversation once; both sorts run within their tasks. Of equal rows the one that is no
    duplicate comes first.
    """
    seen = Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    solid = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(solid == "", "b")
        .when(F.col("nth") > 1, "d")
        .when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "t")
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = (
        F.when(F.col("fault").isin("b", "d"), MUST_GO).when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    )
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(seen))
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_text_order(), "nth")
    return ordered.withColumn("fault", fault).withColumn("code", code).drop("nth")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text, there``: gaps, faults, cost, audit and digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, None, []
        for batch in batches:
            for conv_id, *row, there in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if held is None or conv_id != current:
                    if held:
                        out.append((current, *held.figures()))
                    current, held = conv_id, _Conversation()
                if there:
                    held.add(*row)
            yield _batch(out, batch.schema.field("conv_id").type)
            out = []
        if held:
            yield _batch([(current, *held.figures())], batch.schema.field("conv_id").type)

    bounded_batches(rows.sparkSession)
    ordered = diagnose(rows).select("conv_id", "turn", "role", "text", "code", "fault", "there")
    return ordered.mapInArrow(work, f"conv_id {kind}, {FIGURES}")


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", *(f.split()[0] for f in FIGURES.split(", "))]
    types = [id_type] + [pa.int64()] * 6 + [pa.string()] * 2
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, turn, role, text, edit``; inserted rows have no turn.

    ``repairs`` is the result of ``repair`` on the same rows. Audits are spelled out into one narrow row per
    edit, which meets the row it edits by number.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, audit in enumerate(batch.column("audit").to_pylist()):
                state, row, place, out = START, 0, 0, []
                for at, letter in enumerate(audit):
                    out.append((place, None if letter == "I" else row, letter))
                    row += letter != "I"
                    place += letter != "D"
                    if len(out) == 10_000 or at + 1 == len(audit):
                        places, numbers, letters = zip(*out, strict=True)
                        columns = [pa.array(places, pa.int64()), pa.array(numbers, pa.int64()), pa.array(letters, pa.string())]
                        same_id = pa.array([ids[i].as_py()] * len(out), ids.type)
                        yield pa.RecordBatch.from_arrays([same_id, *columns], ["conv_id", "place", "number", "edit"])
                        out = []

    edits = repairs.select("conv_id", "audit").mapInArrow(spell, f"conv_id {kind}, place bigint, number bigint, edit string")
    order = Window.partitionBy("conv_id").orderBy(*_text_order())
    numbered = rows.where("there").select("conv_id", "turn", "role", "text", (F.row_number().over(order) - 1).cast("bigint").alias("number"))
    met = edits.join(numbered, same(edits, numbered, ["conv_id", "number"]), "left").where("edit <> 'D'")
    # Roles alternate from user on, after a kept system row at place 0.
    leading = Window.partitionBy(edits["conv_id"])
    system = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K"), F.substring("role", 1, 1) == "s")).over(leading)
    turn_of = F.col("place") - F.coalesce(system.cast("int"), F.lit(0))
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.pmod(turn_of, F.lit(2)) == 0, "user").otherwise("assistant")
    return met.select(edits["conv_id"], "place", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
