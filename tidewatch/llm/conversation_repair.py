"""Structure repair of conversations: the cheapest edits that leave an optional system turn and then
alternating user and assistant turns.

Every row is kept (cost 0), given another role (`R`, 1) or deleted (2); empty user or assistant turns
may be inserted anywhere (5 each). A row's first fault counts: blank (nothing but ASCII white space),
duplicate (role and text stand earlier in the conversation) or truncated (its last character that is
no white space is none of `.!?`). Blank and duplicate rows must go; a truncated row that stays costs 5 more.

The edits of a conversation are a path through a lattice of (rows taken, what the roles so far end
with). A bidirectional Dijkstra search finds it: one heap grows from the start, one back from the
goals, until the two least costs add up to more than the best meeting found, so every path of least
cost crosses a pair of settled places. Each settled place holds its least audit (initials of the
edits), and the least concatenation over the crossings is the answer. That is exact: two audits of one cost
that lead to one place are never the beginning of one another, since the letters fix the path and what
follows would be inserts, which cost.

On Spark: one exchange by conversation. Duplicates are numbered by a window within it, rows are sorted and
streamed through Arrow batches. A conversation of any length is held `CHUNK` rows at a time: for a long
one, each chunk is searched from every state it may be entered in to every state it may be left in, and for each
state the least cost, audit and running hash go on. The digest of a conversation's text makes one
task read that conversation, in bounded memory but for the audit itself (a byte an edit).

Defined results: null roles and texts are empty; null turns come first; rows of one turn are in the order
of role and text; null `conv_id` is a conversation of its own; other columns are ignored; an empty table
gives no rows. A conversation whose rows are all lost has zeros, an empty audit and the hash of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
CHUNK, CHUNK_BYTES = 1024, 16 << 20
SPACES = " \t\n\x0b\x0c\r"

#: What the roles so far end with: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
#: The turn that may be made up in each state (initial, next state), and the states that rows lead to as they are.
_NEW = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_KEPT = {("s", START): SYSTEM} | {(initial, state): then for state, (initial, then) in _NEW.items()}
_LEGAL = {"su", "ua", "au"}
_NAMES = {"u": b"user", "a": b"assistant"}

REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
REPAIRED = "conv_id long, place long, edit string, role string, text string"

#: A row to the search: the initial of its role ('-' for any that is not s, u or a), then '!' if it must go, '~' if truncated.
Shape = str


def _row_edges(shape: Shape) -> list[tuple[int, int, int, str]]:
    """Edges of one row: from state, to state, cost, letter."""
    edges = [(state, state, DELETE, "D") for state in range(4)]
    if shape[1] != "!":
        extra = KEEP_TRUNCATED if shape[1] == "~" else 0
        edges += [(state, then, extra, "K") for (initial, state), then in _KEPT.items() if initial == shape[0]]
        edges += [(state, then, extra + REROLE, "R") for state, (_, then) in _NEW.items()]
    return edges


_INSERTS = [(state, then, INSERT, "I") for state, (_, then) in _NEW.items()]
_SHAPES = [a + b for a in "sua-" for b in "!~ "]
_ONWARD = {s: [[e for e in _row_edges(s) if e[0] == state] for state in range(4)] for s in _SHAPES}
_BACK = {s: [[e for e in _row_edges(s) if e[1] == state] for state in range(4)] for s in _SHAPES}
_INSERT_ON = [[e for e in _INSERTS if e[0] == state] for state in range(4)]
_INSERT_BACK = [[e for e in _INSERTS if e[1] == state] for state in range(4)]


class _Side:
    """One of the two searches: least (cost, audit) of the places reached, and those settled."""

    def __init__(self, places: list[tuple[int, int]], sign: int):
        self.best = {place: (0, "") for place in places}
        self.sign, self.settled = sign, set()
        # places of one cost are settled in the order of the rows, so that edges of cost 0 come in time
        self.heap = sorted((0, sign * i, state) for i, state in places)

    def top(self) -> float:
        while self.heap and (self.sign * self.heap[0][1], self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        _, i, state = heappop(self.heap)
        self.settled.add((place := (self.sign * i, state)))
        return place

    def offer(self, place: tuple[int, int], cost: int, audit: str) -> None:
        known = self.best.get(place)
        if known is None or (cost, audit) < known:
            self.best[place] = (cost, audit)
            if known is None or cost < known[0]:
                heappush(self.heap, (cost, self.sign * place[0], place[1]))


def cheapest(shapes: tuple[Shape, ...], start: int = START, goals: tuple[int, ...] = GOALS) -> tuple[int, str] | None:
    """Least cost and, of that cost, least audit of the edits that lead from `start` over all rows to a goal."""
    n = len(shapes)
    forward, reverse = _Side([(0, start)], 1), _Side([(n, goal) for goal in goals], -1)
    best = float("inf")
    while (low := forward.top()) + (high := reverse.top()) <= best and low + high < float("inf"):
        if low <= high:
            i, state = place = forward.settle()
            cost, audit = forward.best[place]
            edges = [(i, e) for e in _INSERT_ON[state]]
            if i < n:
                edges += [(i + 1, e) for e in _ONWARD[shapes[i]][state]]
            for row, (_, then, price, letter) in edges:
                forward.offer((row, then), cost + price, audit + letter)
                if (row, then) in reverse.settled:
                    best = min(best, cost + price + reverse.best[row, then][0])
        else:
            i, state = place = reverse.settle()
            cost, audit = reverse.best[place]
            edges = [(i, e) for e in _INSERT_BACK[state]]
            if i:
                edges += [(i - 1, e) for e in _BACK[shapes[i - 1]][state]]
            for row, (origin, _, price, letter) in edges:
                reverse.offer((row, origin), cost + price, letter + audit)
                if (row, origin) in forward.settled:
                    best = min(best, cost + price + forward.best[row, origin][0])
        if place in forward.settled and place in reverse.settled:
            best = min(best, forward.best[place][0] + reverse.best[place][0])
    if best == float("inf"):
        return None
    audits = []
    for i, state in forward.settled:
        cost, audit = forward.best[i, state]
        if (i, state) in reverse.settled and cost + reverse.best[i, state][0] == best:
            audits.append(audit + reverse.best[i, state][1])
        edges = [(i, e) for e in _INSERT_ON[state]]
        if i < n:
            edges += [(i + 1, e) for e in _ONWARD[shapes[i]][state]]
        for row, (_, then, price, letter) in edges:
            if (row, then) in reverse.settled and cost + price + reverse.best[row, then][0] == best:
                audits.append(audit + letter + reverse.best[row, then][1])
    return int(best), min(audits)


_short = lru_cache(maxsize=50_000)(cheapest)


def search(shapes: tuple[Shape, ...], start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    return (_short if len(shapes) <= 16 else cheapest)(shapes, start, goals)


def edited(audit: str, state: int, rows: list[tuple[bytes, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of the turns that an audit leaves; `state` is the one it begins in."""
    taken = 0
    for letter in audit:
        if letter != "I":
            role, text = rows[taken]
            taken += 1
            if letter == "D":
                continue
        else:
            text = b""
        if letter == "K":
            initial = chr(role[0])
            state = _KEPT[initial, state]
        else:
            initial, state = _NEW[state]
            role = _NAMES[initial]
        yield letter, role, text


class _Way:
    """The cheapest edits so far that end in one state."""

    def __init__(self, cost: int, audit: str, digest, any_turn: bool):
        self.cost, self.audit, self.digest, self.any_turn = cost, audit, digest, any_turn

    def on(self, state: int, cost: int, audit: str, rows: list[tuple[bytes, bytes]]) -> _Way:
        digest, any_turn = self.digest.copy(), self.any_turn
        for _, role, text in edited(audit, state, rows):
            digest.update(b"\n" + role if any_turn else role)
            digest.update(b":" + text)
            any_turn = True
        return _Way(self.cost + cost, self.audit + audit, digest, any_turn)


class _Conversation:
    """Counts and open rows of the conversation that is streamed."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.faults = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.least = self.last_turn = self.initial = None
        self.ways = {START: _Way(0, "", hashlib.sha256(), False)}
        self._clear()

    def _clear(self) -> None:
        self.shapes, self.rows, self.size = [], [], 0

    def add(self, turn: int | None, role: bytes, text: bytes, fault: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.least = turn if self.least is None else self.least
            self.last_turn, self.distinct = turn, self.distinct + 1
        self.faults[fault] += 1
        initial = role[:1].decode("ascii", "replace") if role[:1] in (b"s", b"u", b"a") else "-"
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        self.shapes.append(initial + " !!~"[fault])
        self.rows.append((role, text))
        self.size += len(text)
        if len(self.rows) >= CHUNK or self.size >= CHUNK_BYTES:
            self._advance([(state,) for state in range(4)])

    def _advance(self, goals: list[tuple[int, ...]]) -> None:
        """Takes the open rows: the ways that reach each of `goals`."""
        shapes, ways = tuple(self.shapes), {}
        for goal in goals:
            found = []
            for state, way in self.ways.items():
                if (path := search(shapes, state, goal)) is not None:
                    found.append((way.cost + path[0], way.audit + path[1], state, *path))
            if found:
                _, _, state, cost, audit = min(found)
                ways[goal[0]] = self.ways[state].on(state, cost, audit, self.rows)
        self.ways = ways
        self._clear()

    def report(self) -> tuple:
        self._advance([GOALS])
        way = self.ways[GOALS[0]]
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.distinct
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, way.cost, way.audit, way.digest.hexdigest())


def _prepared(rows: DataFrame, lost: Column | None) -> DataFrame:
    """conv_id, turn, role, text (bytes), fault (0 none, 1 blank, 2 duplicate, 3 truncated), lost; by conversation."""
    gone = F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    shown = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(~gone, F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        F.when(~gone, F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        gone.alias("lost"),
    ).repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    numbered = shown.withColumn("seen", F.row_number().over(alike)).withColumn("bare", F.rtrim(F.col("text"), F.lit(SPACES)))
    fault = (
        F.when(F.col("bare") == "", 1).when(F.col("seen") > 1, 2).when(~F.substring("bare", -1, 1).isin(*".!?"), 3).otherwise(0)
    )
    return numbered.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"),
                           F.coalesce(fault, F.lit(0)).alias("fault"), "lost")


def _ordered(df: DataFrame, *before: str) -> DataFrame:
    return df.sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text")


def repair(rows: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row a conversation: gaps in its turns, faults, illegal neighbours, cost, audit and hash of its repaired text.

    `rows` has conv_id, turn, role and text. Rows for which `lost` is true count for nothing but that
    their conversation exists.
    """

    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f, pa.string() if f in ("audit", "repaired_sha256") else pa.int64()) for f in _fields(REPORT)])
        open_, done = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for conv_id, turn, role, text, fault, gone in zip(*columns):
                if open_ is None or conv_id != open_.conv_id:
                    if open_ is not None:
                        done.append(open_.report())
                    open_ = _Conversation(conv_id)
                if not gone:
                    open_.add(turn, role, text, fault)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)
                done = []
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(open_.report(), kinds)], schema=kinds)

    return _ordered(_prepared(rows, lost)).mapInArrow(reports, REPORT)


def _fields(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def repaired_turns(rows: DataFrame, reports: DataFrame, lost: Column | None = None) -> DataFrame:
    """The turns that the audits of `repair` leave: conv_id, place (from 0), edit (K, R or I), role, text.

    The audit of a conversation travels as a row before its rows, so no row carries it and nothing is joined.
    """
    live = _prepared(rows, lost).where(~F.col("lost")).drop("lost", "fault").withColumn("audit", F.lit(None).cast("string"))
    heads = reports.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("role"),
                           F.lit(None).cast("binary").alias("text"), "audit")
    together = heads.union(live).withColumn("row", F.col("audit").isNull()).repartition("conv_id")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, out = "", 0, START, 0, []

        def edit(conv_id, row: tuple[bytes, bytes] | None) -> None:
            """The inserts before the next row and, if there is one, that row."""
            nonlocal at, state, place
            begun = at
            while at < len(audit) and audit[at] == "I":
                at += 1
            if row is not None:
                at += 1
            for letter, role, text in edited(audit[begun:at], state, [row] if row else []):
                state = _KEPT[chr(role[0]), state] if letter == "K" else _NEW[state][1]
                out.append((conv_id, place, letter, role.decode("utf-8", "replace"), text.decode("utf-8", "replace")))
                place += 1

        conv_id = None
        for batch in batches:
            for key, _, role, text, head, is_row in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if not is_row:
                    edit(conv_id, None)
                    conv_id, audit, at, state, place = key, head, 0, START, 0
                else:
                    edit(key, (role, text))
            if out:
                yield _turn_batch(out)
                out = []
        edit(conv_id, None)
        if out:
            yield _turn_batch(out)

    return _ordered(together, "row").mapInArrow(turns, REPAIRED)


def _turn_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=_fields(REPAIRED))


def damaged(conversations: DataFrame) -> DataFrame:
    """`conversations` with damage that follows a checksum of `conv_id:turn`, and a column `lost` for dropped rows.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats the row and 4
    makes it a user's. Nulls count as one space.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    marked = conversations.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("lost"), F.explode(copies).alias("copy"),
    ).drop("copy")


def _crc32(text: str) -> str:
    """DuckDB expression of the CRC-32 of a text."""
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"


def _least(*ways: tuple[str, int | str, str]) -> str:
    """The least of some ways (kept as cost, 9 digits, then audit), each (way, cost, letter) added to."""
    parts = [f"CASE WHEN {w} IS NOT NULL THEN lpad((left({w}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({w}, 10) || '{letter}' END" for w, cost, letter in ways]
    return f"list_min(list_filter([{', '.join(parts)}], lambda w: w IS NOT NULL))"


def _row_step(state: int) -> str:
    """DuckDB expression of the least way to `state` after the next row, from the ways s0 to s3 before it."""
    gone = [(f"s{state}", DELETE, "D")]
    kept = [f"{_least((f's{before}', 'extra', 'K'))}" for (initial, before), then in _KEPT.items() if then == state]
    wants = [initial for (initial, before), then in _KEPT.items() if then == state]
    new = [(f"s{before}", f"(extra + {REROLE})", "R") for before, (_, then) in _NEW.items() if then == state]
    stay = [f"CASE WHEN NOT must_go AND initial = '{w}' THEN {k} END" for w, k in zip(wants, kept)]
    stay += [f"CASE WHEN NOT must_go THEN {_least(n)} END" for n in new]
    return f"list_min(list_filter([{', '.join([_least(*gone), *stay])}], lambda w: w IS NOT NULL))"


def _insert_step(state: int) -> str:
    """The least way to `state` when one turn more may be made up."""
    return f"list_min(list_filter([s{state}, {', '.join(_least((f's{b}', INSERT, 'I')) for b, (_, then) in _NEW.items() if then == state) or 'NULL'}], lambda w: w IS NOT NULL))"


_MORE = "".join(
    f", w{k} AS (SELECT * EXCLUDE (s0, s1, s2, s3), {', '.join(f'{_insert_step(s)} AS s{s}' for s in range(4))} FROM w{k - 1})" for k in (1, 2, 3)
)

#: The rows of `repair` over `damaged` rows; ways through the lattice row by row, with inserts before each row and at the end.
SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
k AS (SELECT *, {_crc32('key')} % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM d
),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM o
),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM stats
  UNION ALL
  SELECT conv_id, i, {", ".join(f"{_row_step(s)} AS s{s}" for s in range(4))}
  FROM (
    WITH w0 AS (
      SELECT w.conv_id, f.i, w.s0, w.s1, w.s2, w.s3, f.initial, f.fault IN ('blank', 'duplicate') AS must_go,
        CASE WHEN f.fault = 'truncated' THEN {KEEP_TRUNCATED} ELSE 0 END AS extra
      FROM ways AS w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    ){_MORE}
    SELECT * FROM w3
  )
),
ends AS (
  WITH w0 AS (SELECT ways.* FROM ways JOIN stats ON ways.conv_id IS NOT DISTINCT FROM stats.conv_id AND ways.i = stats.n){_MORE}
  SELECT conv_id, list_min(list_filter([s0, s3], lambda w: w IS NOT NULL)) AS way FROM w3
),
letters AS (
  SELECT conv_id, k, substr(way, 9 + k::INT, 1) AS letter,
    len(replace(substr(way, 10, k::INT), 'I', '')) AS i
  FROM ends, unnest(range(1, len(way) - 8)) AS t(k)
),
kept AS (
  SELECT l.conv_id, l.k, l.letter, f.role, f.text, f.initial, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.k) AS place
  FROM letters AS l LEFT JOIN f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i
  WHERE l.letter <> 'D'
),
turns AS (
  SELECT *, place - (first_value(letter = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY place))::INT AS pair_place FROM kept
),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN pair_place % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS repaired
  FROM turns GROUP BY conv_id
)
SELECT a.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate,
  coalesce(s.truncated, 0)::BIGINT AS truncated, coalesce(s.illegal, 0)::BIGINT AS illegal, coalesce(left(e.way, 9)::BIGINT, 0) AS cost,
  coalesce(substr(e.way, 10), '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a
LEFT JOIN stats AS s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""
