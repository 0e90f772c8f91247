"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is rows (conv_id, turn, text) in order of turn; a text has one or more lines. Hidden
states are a role with "begins a turn" or "goes on". What is seen of a line are its speaker marker (fixed names of
roles, a bare dash or bracket, none), whether it opens its row, its length, a question mark
at its end and whether it looks like code or a list. Transitions and emissions are
smoothed counts over labelled conversations; the path is Viterbi's.

Long conversations are cut into blocks of ``BLOCK`` turns. A block is summed up by the best score
between each pair of states before and after it; these small matrices are chained for each conversation, and each
block is then decoded between its two known states. So no task holds a conversation's texts, and
the path is the one that decoding in one piece gives.

A turn's content is its lines as they stand, less the marker that begins it where that names the role the path gives; nothing else is taken from the text.

Null texts are one empty line. Rows with null turns come first, equal turns in order of text. Null conversation ids
are one conversation. Without labelled rows the counts are the smoothing alone and markers decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintmill.llm.common import cut, fold

BLOCK = 64
# Roles and the names by which transcripts call them.
ROLES = ("system", "user", "assistant", "tool")
NAMES = {
    "system": ("system", "context", "instructions", "setup"),
    "user": ("user", "human", "customer", "question", "q", "prompt", "client", "instruction", "you", "guest", "student"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "agent", "model", "chatbot", "support", "teacher"),
    "tool": ("tool", "function", "observation", "tool_result"),
}
SEEN = ("marker", "opens", "length", "question", "shape")
SIZES = (6, 2, 4, 2, 3)
STATES = 2 * len(ROLES)  # 2 * role begins a turn of it, 2 * role + 1 goes on with it

_ROLE_OF = {n: i for i, names in enumerate(NAMES.values()) for n in names}
#: A marker at the start of a line: emphasised, a heading of its own, in brackets, or a plain name and colon. What follows it is the text, untouched.
_MARKER = re.compile(
    r"(?:\*{1,2}(?P<strong>[A-Za-z_]{1,12})(?::\*{1,2}|\*{1,2}:?)|#{1,4}[ \t]*(?P<heading>[A-Za-z_]{1,12}):?[ \t]*$|\[(?P<square>[A-Za-z_]{1,12})\]:?|<\|?(?P<angle>[A-Za-z_]{1,12})\|?>|(?P<plain>[A-Za-z_]{1,12})[ \t]?:)[ \t]?"
)
_BARE = re.compile(r"\s*(?:[-–—>•]{1,2}|\[\d+\])\s+")


def _marker(line: str) -> tuple[int | None, int]:
    """(role that a marker at the start of the line names, where the text goes on)."""
    m = _MARKER.match(line)
    role = _ROLE_OF.get(m.group(m.lastgroup).lower()) if m else None
    return (None, 0) if role is None else (role, m.end())


def observe(line: str, opens: bool) -> tuple[int, int, int, int, int]:
    """What is seen of one line; the marker is 1 + a role, 5 for a bare mark, 0 for none."""
    role, _ = _marker(line)
    marker = 1 + role if role is not None else 5 if _BARE.match(line) else 0
    n = len(line)
    shape = 1 if line.startswith(("    ", "\t", "```")) else 2 if re.match(r"\s*(?:\d+[.)]|\*)\s", line) else 0
    return marker, int(opens), 0 if n < 40 else 1 if n < 160 else 2 if n < 600 else 3, int(line.rstrip().endswith("?")), shape


def without_marker(line: str, role: int) -> str | None:
    """The line without a marker of this role; None for a heading that was nothing else. Dashes, numbers and other roles' names are text."""
    said, end = _marker(line)
    if said != role:
        return line
    return None if line.startswith("#") else line[end:]


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray  # log probability of state j after state i
    emit: list[np.ndarray]  # per observation: states x values

    def scores(self, seen: list[tuple]) -> np.ndarray:
        """Log probability of each line's observations, lines x states."""
        a = np.array(seen, dtype=np.int64).reshape(-1, len(SEEN))
        return sum(e[:, a[:, k]].T for k, e in enumerate(self.emit))


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            r = ROLES.index(role)
            for i, line in enumerate(_lines(text)):
                state = 2 * r + (i > 0)
                for k, value in enumerate(observe(line, i == 0)):
                    found[state, k, value] += 1
    keys = list(found)
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keys], pa.int32()) for i in range(3)] + [pa.array([found[x] for x in keys], pa.int64())], ["state", "kind", "value", "n"])


def fit(labelled: DataFrame, smoothing: float = 0.5) -> Model:
    """A model from ``labelled(conv_id, turn, role, text)``: counts over all rows with a known role."""
    known = labelled.where(F.col("role").isin(*ROLES)).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    emit = [np.full((STATES, size), smoothing) for size in SIZES]
    for k in range(1, len(ROLES) + 1):  # before any data a role's own marker speaks for its beginning
        emit[0][2 * (k - 1), k] += 4 * smoothing
    for r in known.select("role", "text").mapInArrow(_counts, "state int, kind int, value int, n long").groupBy("state", "kind", "value").agg(F.sum("n").alias("n")).collect():
        emit[r["kind"]][r["state"], r["value"]] += r["n"]
    turns = known.select("conv_id", "turn", "role")
    after = turns.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("role").alias("next"))
    moves = np.full((len(ROLES), len(ROLES)), smoothing)
    for r in turns.join(after, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).groupBy("role", "next").count().collect():
        moves[ROLES.index(r["role"]), ROLES.index(r["next"])] += r["count"]
    first = np.full(len(ROLES), smoothing)
    for r in turns.where("turn = 0").groupBy("role").count().collect():
        first[ROLES.index(r["role"])] += r["count"]
    lines = np.array([emit[1][2 * r : 2 * r + 2].sum(axis=1) for r in range(len(ROLES))])  # begun, gone on
    step = np.zeros((STATES, STATES))
    for r in range(len(ROLES)):
        stay = lines[r, 1] / lines[r].sum()
        for state in (2 * r, 2 * r + 1):
            step[state, 2 * r + 1] = stay
            step[state, 0::2] = (1 - stay) * moves[r] / moves[r].sum()
    start = np.full(STATES, 1e-9)
    start[0::2] = first / first.sum()
    return Model(np.log(start), np.log(np.maximum(step, 1e-12)), [np.log(e / e.sum(axis=1, keepdims=True)) for e in emit])


def viterbi(model: Model, scores: np.ndarray, before: np.ndarray, end: int | None = None) -> tuple[np.ndarray, int]:
    """Best path over lines; ``before`` scores the states ahead of the first line. Also the state ahead of it."""
    n = len(scores)
    back = np.zeros((n, STATES), dtype=np.int64)
    v = before
    for i in range(n):
        moved = v[:, None] + model.step
        back[i] = moved.argmax(axis=0)
        v = moved.max(axis=0) + scores[i]
    state = int(v.argmax()) if end is None else end
    path = np.zeros(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        path[i], state = state, int(back[i, state])
    return path, state


def _summary(model: Model, scores: np.ndarray) -> np.ndarray:
    """Best score from each state ahead of the lines to each state at their end."""
    m = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(m, 0.0)
    for row in scores:
        m = (m[:, :, None] + model.step[None, :, :]).max(axis=1) + row
    return m




def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows that share the keys, from batches in their order."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[-1][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block_scores(model: Model, rows: list[dict], first: bool) -> tuple[list[tuple[int, str]], np.ndarray]:
    lines = [(k, line, i == 0) for k, r in enumerate(rows) for i, line in enumerate(_lines(r["text"]))]
    scores = model.scores([observe(line, opens) for _, line, opens in lines])
    if first:
        # whatever stands ahead of a conversation moves to its first state as ``start`` says
        scores[0] += model.start - model.step[0]
    return [(k, line) for k, line, _ in lines], scores


def _summaries(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("conv_id", "block")):
            _, scores = _block_scores(shared.value, rows, rows[0]["first"])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]["conv_id"]], pa.int64()), pa.array([rows[0]["block"]], pa.int64()), pa.array([_summary(shared.value, scores).ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "block", "matrix"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between a conversation's blocks, by Viterbi over their matrices."""
    for rows in _groups(batches, ("conv_id",)):
        v, back = np.array([0.0] + [-np.inf] * (STATES - 1)), []
        for r in rows:
            moved = v[:, None] + np.array(r["matrix"]).reshape(STATES, STATES)
            back.append(moved.argmax(axis=0))
            v = moved.max(axis=0)
        state, ends = int(v.argmax()), []
        for b in reversed(back):
            ends.append((int(b[state]), state))
            state = ends[-1][0]
        ends.reverse()
        yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([r["block"] for r in rows], pa.int64()), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())], ["c_id", "c_block", "state_in", "state_out"])


def _decoded(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("conv_id", "block")):
            lines, scores = _block_scores(shared.value, rows, rows[0]["first"])
            ahead = np.full(STATES, -np.inf)
            ahead[rows[0]["state_in"]] = 0.0
            path, _ = viterbi(shared.value, scores, ahead, rows[0]["state_out"])
            out: list[list] = []
            last = None
            for (k, line), state in zip(lines, path.tolist(), strict=True):
                begins = state % 2 == 0
                if begins or last != k:
                    text = without_marker(line, state // 2) if begins else line
                    out.append([k, state // 2, begins, [] if text is None else [text]])
                else:
                    out[-1][3].append(line)
                last = k
            parts: Counter = Counter()
            columns: list[list] = [[] for _ in range(7)]
            for k, role, begins, text in out:
                content = "\n".join(text)
                head = f"<|{ROLES[role]}|>\n" if begins else ""
                for column, value in zip(columns, (rows[k]["conv_id"], rows[k]["turn"], parts[k], ROLES[role], begins, content, f"{head}{content}\n<|end|>\n"), strict=True):
                    column.append(value)
                parts[k] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "turn", "part", "role", "begins_turn", "content", "rendered"])

    return run


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """Recovered turns of ``transcripts(conv_id, turn, text)``, a row for each piece of a turn in a source row.

    conv_id, turn, part, role, begins_turn, content (marker removed), rendered. Pieces that go on
    with a turn have no head.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    rows = transcripts.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).cast("long"))
    firsts = rows.groupBy("conv_id").agg(F.min("block").alias("first_block")).withColumnRenamed("conv_id", "f_id")
    rows = cut(rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_id"))).select("conv_id", "turn", "text", "block", (F.col("block") == F.col("first_block")).alias("first")))
    blocks = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    summed = blocks.mapInArrow(_summaries(shared), "conv_id long, block long, matrix array<double>")
    ends = cut(summed.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, "c_id long, c_block long, state_in int, state_out int"))
    known = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("block") == F.col("c_block")))
    ordered = known.select("conv_id", "turn", "text", "block", "first", "state_in", "state_out").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    return ordered.mapInArrow(_decoded(shared), "conv_id long, turn long, part int, role string, begins_turn boolean, content string, rendered string")


def as_transcript(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as raw text: how speakers are marked differs by conversation, and some turns have no marker."""

    def style(*names: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in zip(ROLES, names, strict=True) for x in pair]), F.coalesce("role", F.lit("")))

    pick = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    marker = (
        F.when(pick == 0, style("System: ", "User: ", "Assistant: ", "Tool: "))
        .when(pick == 1, style("Context: ", "Human: ", "AI: ", "Function: "))
        .when(pick == 2, style("### System\n", "### Instruction\n", "### Response\n", "### Tool\n"))
        .when(pick == 3, style("[system] ", "[user] ", "[assistant] ", "[tool] "))
        .when(pick == 4, style("Context: ", "Q: ", "A: ", "Observation: "))
        .otherwise(style("**System:** ", "**User:** ", "**Assistant:** ", "**Tool:** "))
    )
    unmarked = F.pmod(F.xxhash64(F.lit(3), "conv_id", "turn"), F.lit(7)) == 0
    text = F.concat(F.when(unmarked, F.lit("")).otherwise(F.coalesce(marker, F.lit(""))), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The recovered turns of the table's transcripts; the model learns from four of five conversations."""
    raw = as_transcript(conversations)
    return parse(raw, fit(raw.where(fold(F.col("conv_id")) != 0)))
