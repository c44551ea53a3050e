"""Chat transcripts to canonical turns: a hidden Markov model recovers who speaks in each line.

A transcript is a sequence of pieces of text with any number of lines.  The states of the model are the roles, each as the
first line of a turn or a later one.  A line shows five features (speaker marker, marker alone on its line, length, a closing
question mark, an empty line before it).  Transitions and features are counted over all labelled training transcripts.
Viterbi finds the best sequence of states, markers are cut off, and each turn is rendered as

    <|role|>
    text
    <|end|>

Pieces are range-sorted by conversation and position and read as a stream in chunks of bounded size, so a conversation of any
length is spread over tasks.  Every chunk is summed up by a matrix: the best score from each state before it to each state at
its end.  Conversations of several chunks are solved on these matrices first, forwards and back; after that every chunk is
decoded by itself between its two known states.

Defined results: a null text is an empty line; a null conversation is a conversation of its own and null positions come
first; pieces with equal positions follow each other in the order of their texts; repeated rows are repeated pieces; a null
or unknown role is not learned from; without training data all roles are equally likely to go on and markers decide; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import fold_of, materialise

ROLES = ("system", "user", "assistant")
#: States: first line of a turn of each role, then later line of a turn of each role.
STATES = [(role, first) for first in (True, False) for role in ROLES]
#: Pieces and characters of a chunk (a longer piece is a chunk of its own).
CHUNK_PIECES, CHUNK_CHARS = 512, 1 << 20
HELD_OUT_PARTS, HELD_OUT = 5, 1
#: Words that speakers are marked with.
SPEAKERS = {
    "system": "system instruction instructions context",
    "user": "user human customer question q prompt client me",
    "assistant": "assistant ai bot agent answer a response model",
}
_ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words.split()}
_MARKER = re.compile(
    r"\s*(?:(?P<open>#{1,6}\s*|\*\*|<\|?|\[)(?P<name>\w{1,16})(?P<close>\s*:?\*\*:?|\|?>|\]|\s*:|\s*$)|(?P<plain>\w{1,16})\s*:)\s*(?::\s*)?")
_NEVER = -1e30


def marker(line: str) -> tuple[str, int]:
    """The role that a line's speaker marker names ("" for none, "other" for an unknown speaker) and where the marker ends."""
    found = _MARKER.match(line)
    if not found:
        return "", 0
    role = _ROLE_OF.get((found["name"] or found["plain"]).lower())
    if role is None:
        return ("other", 0) if found["plain"] else ("", 0)
    return role, found.end()


def features(line: str, blank_before: bool) -> tuple:
    """What the model sees of a line: (feature, value) pairs."""
    role, end = marker(line)
    size = len(line.strip())
    long = next(n for n, most in enumerate((0, 20, 60, 150, 400, 1 << 62)) if size <= most)
    return (("marker", role), ("alone", bool(role) and end >= len(line)), ("long", long),
            ("asks", line.rstrip().endswith("?")), ("gap", blank_before))


_VALUES = {"marker": 5, "alone": 2, "long": 6, "asks": 2, "gap": 2}


class Model:
    """Log probabilities: start[s], step[s][t] and, by feature and value, one number for each state."""

    def __init__(self, moves: dict[tuple[str, str], int], seen: dict[tuple[int, str, str], int]) -> None:
        turns = {r: sum(n for (a, _), n in moves.items() if a == r) for r in ("", *ROLES)}
        lines = Counter()
        for (s, feature, _), n in seen.items():
            lines[s] += n if feature == "marker" else 0
        go_on = [np.log((lines[3 + k] + 1) / (lines[k] + lines[3 + k] + 2)) for k in range(3)]
        change = {(a, b): np.log((moves.get((a, b), 0) + 1) / (turns[a] + 3)) for a in ("", *ROLES) for b in ROLES}
        self.start = np.array([change["", r] if first else _NEVER for r, first in STATES])
        self.step = np.full((6, 6), _NEVER)
        for s, (a, _) in enumerate(STATES):
            k = ROLES.index(a)
            stop = np.log1p(-np.exp(go_on[k]))
            self.step[s, 3 + k] = go_on[k]
            for t, b in enumerate(ROLES):
                self.step[s, t] = stop + change[a, b]
        self.seen, self.lines = seen, lines

    @functools.lru_cache(maxsize=4096)  # noqa: B019  one model a task, and few kinds of lines
    def emission(self, shown: tuple) -> np.ndarray:
        out = np.zeros(6)
        for feature, value in shown:
            for s, (role, first) in enumerate(STATES):
                expected = 1.0 if feature == "marker" and first and value == role else 0.0  # what a marker means, before any data
                out[s] += np.log((self.seen.get((s, feature, str(value)), 0) + 0.1 + expected) / (self.lines[s] + 0.1 * _VALUES[feature] + (feature == "marker")))
        return out

    def emissions(self, lines: list[str], blank_before: bool) -> np.ndarray:
        rows = []
        for line in lines:
            rows.append(self.emission(features(line, blank_before)))
            blank_before = not line.strip()
        return np.array(rows).reshape(-1, 6)

    def summary(self, emitted: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines to each state of the last of them."""
        best = np.where(np.eye(6, dtype=bool), 0.0, _NEVER)
        for row in emitted:
            best = (best[:, :, None] + self.step[None]).max(1) + row
        return best

    def decode(self, emitted: np.ndarray, before: int, after: int) -> list[int]:
        """The best states; ``before``: the state before the lines (-1: none); ``after``: that of the last line (-1: any)."""
        if not len(emitted):
            return []
        score = (self.start if before < 0 else self.step[before]) + emitted[0]
        back = []
        for row in emitted[1:]:
            through = score[:, None] + self.step
            back.append(through.argmax(0))
            score = through.max(0) + row
        states = [int(score.argmax()) if after < 0 else after]
        for came in reversed(back):
            states.append(int(came[states[-1]]))
        return states[::-1]


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def train(pieces: DataFrame) -> Model:
    """Count over labelled pieces (conv_id, position, text, role), each of which is one turn."""
    known = pieces.filter(F.col("role").isin(*ROLES)).select("conv_id", F.col("position").cast("long").alias("position"), "text", "role")
    turns = known.select("conv_id", "position", "role").distinct()
    next_ = turns.select(F.col("conv_id").alias("c"), (F.col("position") - 1).alias("p"), F.col("role").alias("then"))
    steps = turns.join(next_, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p"))).groupBy("role", "then").count()
    starts = turns.join(turns.groupBy("conv_id").agg(F.min("position").alias("p")).withColumnRenamed("conv_id", "c"),
                        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") == F.col("p"))).groupBy("role").count()
    moves = {(r["role"], r["then"]): r["count"] for r in steps.collect()} | {("", r["role"]): r["count"] for r in starts.collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            found: Counter = Counter()
            for text, role in zip(batch.column("text").to_pylist(), batch.column("role").to_pylist()):
                blank, state = False, ROLES.index(role)
                for line in lines_of(text):
                    found.update((state, feature, str(value)) for feature, value in features(line, blank))
                    blank, state = not line.strip(), 3 + ROLES.index(role)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()),
                 pa.array([found[k] for k in keys], pa.int64())], ["state", "feature", "value", "n"])

    seen = known.select("text", "role").mapInArrow(count, "state int, feature string, value string, n long").groupBy(
        "state", "feature", "value").agg(F.sum("n").alias("n")).collect()  # states x values, a fixed number
    return Model(moves, {(r["state"], r["feature"], r["value"]): r["n"] for r in seen})


def _chunks(pieces: DataFrame, model: Model, most: int, chars: int) -> DataFrame:
    """Runs of pieces of one conversation, in order: conv_id, part, at (their order), positions, texts, blank and best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, conv = TaskContext.get().partitionId(), 0, object()
        held: list[tuple] = []
        blank = False

        def chunk() -> pa.RecordBatch:
            lines = [line for _, text in held for line in lines_of(text)]
            best = model.summary(model.emissions(lines, blank))
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.string()), pa.array([part]), pa.array([at]), pa.array([[p for p, _ in held]], pa.list_(pa.int64())),
                 pa.array([[t or "" for _, t in held]], pa.list_(pa.string())), pa.array([blank]), pa.array([best.ravel().tolist()], pa.list_(pa.float64()))],
                ["conv_id", "part", "at", "positions", "texts", "blank", "best"])

        size = 0
        for batch in batches:
            for this, position, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "text"))):
                if held and (this != conv or len(held) >= most or size >= chars):
                    yield chunk()
                    blank = this == conv and not lines_of(held[-1][1])[-1].strip()
                    held, size, at = [], 0, at + 1
                conv = this
                held.append((position, text))
                size += len(text or "")
        if held:
            yield chunk()

    ordered = pieces.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("position").cast("long").alias("position"),
                            F.col("text").cast("string").alias("text"))
    order = ["conv_id", "position", F.xxhash64("text")]
    schema = "conv_id string, part int, at int, positions array<long>, texts array<string>, blank boolean, best array<double>"
    return ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, schema.replace("part int, at int", "part long, at long"))


def _boundaries(chunks: DataFrame, model: Model) -> DataFrame:
    """(part, at, before, after): the states around every chunk of the conversations that have several."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "at"])
        best = np.array(rows["best"].tolist()).reshape(-1, 6, 6)
        # Forwards: the best score of each state before each chunk.  The first chunk starts from no state, which decode() scores
        # with ``start``; here the best first step is put in place of the step from each state.
        scores, entry = [], None
        for m, first in zip(best, rows["first"]):
            if entry is None:
                entry = np.array(first)
                scores.append(None)
                continue
            scores.append(entry)
            entry = (entry[:, None] + m).max(0)
        after = [int(entry.argmax())]
        before = []
        for score, m in zip(scores[::-1], best[::-1]):
            came = -1 if score is None else int((score + m[:, after[-1]]).argmax())
            before.append(came)
            after.append(came)
        return pd.DataFrame({"part": rows["part"], "at": rows["at"], "before": before[::-1], "after": after[:-1][::-1]})

    @F.pandas_udf("array<double>")
    def first(texts: pd.Series) -> pd.Series:
        out = []
        for pieces in texts:
            emitted = model.emissions([line for text in pieces for line in lines_of(text)], False)
            score = model.start + emitted[0]
            for row in emitted[1:]:
                score = (score[:, None] + model.step).max(0) + row
            out.append(score.tolist())
        return pd.Series(out)

    several = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"))
    rows = chunks.join(several, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("conv_id", "part", "at", "best", first("texts").alias("first"))
    return rows.groupBy("conv_id").applyInPandas(solve, "part long, at long, before int, after int")


def parse(pieces: DataFrame, model: Model, most: int = CHUNK_PIECES, chars: int = CHUNK_CHARS) -> DataFrame:
    """The turns of all transcripts: conv_id, position and line where they begin, role, n_lines, text, rendered, continues.

    ``continues`` marks the rest of a turn whose beginning is in the chunk before; such a row is rendered without its head.
    """
    chunks = materialise(_chunks(pieces, model, most, chars), "transcript-chunks")
    bounds = materialise(_boundaries(chunks, model), "transcript-bounds")
    joined = chunks.drop("best").join(bounds, ["part", "at"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                where = [(p, n, line) for p, text in zip(row["positions"], row["texts"]) for n, line in enumerate(lines_of(text))]
                emitted = model.emissions([line for _, _, line in where], row["blank"])
                states = model.decode(emitted, -1 if row["before"] is None else row["before"], -1 if row["after"] is None else row["after"])
                for (position, n, line), state in zip(where, states):
                    role, begins = STATES[state]
                    if begins or not out or out[-1][0] is not row:
                        out.append((row, position, n, role, not begins, []))
                    # A marker is cut off where it names the speaker that was found.
                    named, end = marker(line)
                    out[-1][5].append(line[end:] if begins and named == role else line)
            texts = [_trimmed(lines) for *_, lines in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["conv_id"] for r, *_ in out], pa.string()), pa.array([p for _, p, *_ in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                 pa.array([x[3] for x in out], pa.string()), pa.array([len(x[5]) for x in out], pa.int64()), pa.array(texts, pa.string()),
                 pa.array([x[4] for x in out], pa.bool_())], ["conv_id", "position", "line", "role", "n_lines", "text", "continues"])

    turns = joined.mapInArrow(run, "conv_id string, position long, line long, role string, n_lines long, text string, continues boolean")
    head = F.when(F.col("continues"), F.lit("")).otherwise(F.concat(F.lit("<|"), "role", F.lit("|>\n")))
    kind = dict(pieces.dtypes)["conv_id"]
    return turns.withColumn("rendered", F.concat(head, "text", F.lit("\n<|end|>\n"))).withColumn("conv_id", F.col("conv_id").cast(kind))


def _trimmed(lines: list[str]) -> str:
    """The lines without empty ones at either end."""
    full = [k for k, line in enumerate(lines) if line.strip()]
    return "\n".join(lines[full[0]: full[-1] + 1]) if full else ""


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of the turns of a table of conversations: conv_id, position, text and role (for training and checks).

    Every conversation has one of four marker styles, by a hash of its id.  One turn in six (by a hash, never the first) has no
    marker, so that only the other lines tell who speaks.  Turns end with an empty line in the styles without headings.
    """
    styles = [("System: ", "User: ", "Assistant: ", "\n"), ("### System:\n", "### Human:\n", "### Response:\n", ""),
              ("Instructions: ", "Q: ", "A: ", "\n"), ("<|system|>\n", "<|user|>\n", "<|assistant|>\n", "")]
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    bare = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(6)) == 0) & (F.col("turn") > 0)
    head = F.lit("")
    tail = F.lit("")
    for k, (*marks, end) in enumerate(styles):
        for role, mark in zip(ROLES, marks):
            head = F.when((style == k) & (F.col("role") == role) & ~bare, F.lit(mark)).otherwise(head)
        tail = F.when(style == k, F.lit(end)).otherwise(tail)
    return conversations.select("conv_id", F.col("turn").alias("position"), F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"), "role")


def op6_transcripts(spark, sf_dir: str) -> DataFrame:
    pieces = as_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    model = train(pieces.filter(fold_of("conv_id", HELD_OUT_PARTS) != HELD_OUT))
    return parse(pieces.drop("role"), model)
